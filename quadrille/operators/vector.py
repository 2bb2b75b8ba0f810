"""Dense retrieval: inner products, exact top-k in blocks or by inverted-file cells, encoders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, stored
from .ground import rank_in
from .vector_index import VectorIndex, cell_centres, kept_vectors, search_once

__all__ = ["VectorIndex", "cell_centres", "kept_vectors"]

#: At most so many scores are held at a time.
SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, larger_id_first: bool = False, query_rows: int = 4096, corpus_rows: int = 65_536) -> DataFrame:
    """(quid, rank, fact_id, score) of queries (quid, vector) against corpus (fact_id, vector); score down, then id.

    Exact.  Query blocks meet corpus blocks as groups of bounded size (one matrix product each), and
    only ``k`` rows a query and block are shuffled on; nothing is broadcast."""
    counts = [df.select(F.count("*").alias("n")).first()["n"] for df in (queries, corpus)]
    nq, nc = max(1, -(-counts[0] // query_rows)), max(1, -(-counts[1] // corpus_rows))
    q = queries.select("quid", "vector", F.pmod(F.xxhash64("quid"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = corpus.select("fact_id", "vector", F.pmod(F.xxhash64("fact_id"), F.lit(nc)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    part = _best_of_blocks(q, c, k, larger_id_first)
    return rank_in(part, ["quid"], [F.desc("score"), F.desc("fact_id") if larger_id_first else F.asc("fact_id")], k).select("quid", "rank", "fact_id", "score")


def _best_of_blocks(q: DataFrame, c: DataFrame, k: int, larger_id_first: bool = False) -> DataFrame:
    """(quid, fact_id, score): the ``k`` best of each query in each group (qb, cb)."""
    sign = -1 if larger_id_first else 1

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"quid": pd.Series(dtype="int64"), "fact_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, y, ids = np.stack(a["vector"].to_list()), np.stack(b["vector"].to_list()), b["fact_id"].to_numpy(np.int64)
        row, col, score = best_pairs(x, y, sign * ids, k)
        return pd.DataFrame({"quid": a["quid"].to_numpy(np.int64)[row], "fact_id": ids[col], "score": score})

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "quid long, fact_id long, score double")


#: Rows of a corpus whose scores are held at a time, those that share one greatest score, and pairs that are scored in double precision at once.
TILE, SHARED, PAIRS = 8192, 64, 8192


def best_pairs(x: np.ndarray, y: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, row of ``y``, inner product): the ``k`` best of each row of ``x``, ties by ``order``.

    Products in single precision, whose error is bounded, tell which pairs can be among the best; these are scored in double
    precision.  The kth greatest of the greatest scores of ``SHARED`` rows each is not above the kth best score."""
    scaled = [(v / 2.0 ** np.frexp(np.abs(v).max(initial=0))[1]).astype(np.float32) for v in (x, y)]
    long, longest = np.linalg.norm(scaled[0].astype(float), axis=1), np.linalg.norm(scaled[1].astype(float), axis=1).max()
    slack = 2 * x.shape[1] * (2.0**-120 + 2.0**-22 * long * longest).astype(np.float32)
    out, step = [], max(1, SCORES // TILE)
    for i in range(0, len(x), step):
        some, room, found = scaled[0][i : i + step], slack[i : i + step], []
        tops = np.full((len(some), k), -np.inf, np.float32)
        for j in range(0, len(y), TILE):
            score = some @ scaled[1][j : j + TILE].T
            if score.shape[1] % SHARED:
                score = np.pad(score, ((0, 0), (0, -score.shape[1] % SHARED)), constant_values=-np.inf)
            score = score.reshape(len(some), SHARED, -1)
            top = score.max(axis=1)
            tops = np.partition(np.concatenate([tops, top], axis=1), -k, axis=1)[:, -k:]
            least = tops.min(axis=1) - room
            row, group = np.nonzero(top >= least[:, None])
            rough = score[row, :, group]
            pair, at = np.nonzero(rough >= least[row, None])
            col = j + at * score.shape[2] + group[pair]
            inside = col < len(y)
            found.append((row[pair][inside], col[inside], rough[pair, at][inside]))
        row, col, rough = (np.concatenate(f) for f in zip(*found, strict=True))
        kept = rough >= (tops.min(axis=1) - room)[row]
        row, col = row[kept], col[kept]
        exact = np.concatenate([np.einsum("ij,ij->i", x[i + row[p : p + PAIRS]].astype(float), y[col[p : p + PAIRS]].astype(float)) for p in range(0, len(row), PAIRS)] or [np.zeros(0)])
        by = np.lexsort((order[col], -exact, row))
        row, col, exact = row[by], col[by], exact[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((i + row[kept], col[kept], exact[kept]))
    return tuple(np.concatenate(f) for f in zip(*out, strict=True))


def gather(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits with the text of their fact (fact_id, fact); ids without a fact are dropped."""
    return hits.join(facts, "fact_id")


def top_k_cells(queries: DataFrame, corpus: DataFrame, k: int = 20, cells: int = 64, probes: int = 16, centres: np.ndarray | None = None, query_rows: int = 16_384, corpus_rows: int = 65_536) -> DataFrame:
    """Exact top-k by the cells of an index that is made for this search; to keep one, use ``VectorIndex``."""
    return search_once(queries, corpus, scratch_path(corpus.sparkSession), k, cells, probes, centres, query_rows=query_rows, corpus_rows=corpus_rows)


Encoder = Callable[[list[str]], np.ndarray]


#: Grams whose places an offline encoder remembers.
REMEMBERED = 1 << 20


def hashing_encoder(dim: int = 256) -> Encoder:
    """The offline encoder: hashed words and character trigrams, unit length; deterministic.  The first four hex digits
    of a gram's MD5 name its place, the fifth its sign.  A gram that comes again is not hashed again."""
    places: dict[str, tuple[int, float]] = {}

    def place(gram: str) -> tuple[int, float]:
        h = hashlib.md5(gram.encode()).hexdigest()
        if len(places) >= REMEMBERED:
            places.clear()
        return places.setdefault(gram, (int(h[:4], 16) % dim, 1.0 if h[4] >= "8" else -1.0))

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            low = (t or "").lower()
            at = [places.get(g) or place(g) for g in re.findall(r"\w+", low) + [low[k : k + 3] for k in range(len(low) - 2)]]
            if at:
                where, sign = zip(*at, strict=True)
                out[i] = np.bincount(where, sign, dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode_texts(texts: DataFrame, text_col: str, encoder: Encoder | None = None) -> DataFrame:
    """``texts`` with a column vector, by Arrow batches; the encoder is made once and shipped."""
    encoder = encoder or hashing_encoder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(encoder(b.fillna("").tolist())))

    return texts.withColumn("vector", run(F.col(text_col)))


def rank_relations(relations: DataFrame, names: DataFrame, k: int = 3, encoder: Encoder | None = None) -> DataFrame:
    """(relation, cand_rank, rel): the ``k`` best dictionary relations (name, id) of each different relation text.

    Dictionary vectors are made once; ties go to the larger id."""
    q = encode_texts(relations.select("relation").where("relation is not null").distinct().withColumn("quid", F.xxhash64("relation")), "relation", encoder)
    c = encode_texts(names.select("name", F.col("id").cast("long").alias("fact_id")), "name", encoder)
    hits = top_k(q.select("quid", "vector"), c.select("fact_id", "vector"), k, larger_id_first=True)
    return hits.join(q.select("quid", "relation"), "quid").join(c.select("fact_id", F.col("name").alias("rel")), "fact_id").select("relation", F.col("rank").alias("cand_rank"), "rel")


def fact_vectors(facts: DataFrame, encoder: Encoder | None = None, store: str | None = None, encoder_name: str = "hashing-256") -> DataFrame:
    """(fact_id, fact, vector) of (line_no, fact).  With ``store``, a folder, only texts that the encoder of that name has not met
    there are encoded, and kept for later runs."""
    rows = facts.select(F.col("line_no").alias("fact_id"), "fact")
    if store is None:
        # A small file is one task's read, but its texts are many tasks' work.
        parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return encode_texts(rows.repartition(parts, "fact_id"), "fact", encoder)
    return kept_vectors(rows, "fact", store, encoder_name, lambda new: encode_texts(new, "text", encoder))[0]


def cells_for(n: int) -> int:
    """Cells of a kept index of n vectors: about their square root."""
    return max(1, min(1024, int(n**0.5)))


#: Questions of a block, whose copies of the facts are the bulk of what moves.
QUESTION_ROWS = 32_768


def search_vectors(questions: DataFrame, known: DataFrame, k: int = 20, encoder: Encoder | None = None, only: DataFrame | None = None, cells: int | None = None, index: VectorIndex | None = None) -> DataFrame:
    """(quid, rank, fact_id, score, fact): the ``k`` best of ``known`` (fact_id, fact, vector) for each question; ``only``
    (quid) limits the questions.  ``index`` is the kept index of the same vectors; without one blocks are compared, as an index
    that is made for one search of texts costs more than it spares, unless ``cells`` asks for one.  All ways are exact."""
    asked = questions if only is None else questions.join(only.select("quid"), "quid", "left_semi")
    q = encode_texts(asked.select("quid", "question"), "question", encoder).select("quid", "vector")
    corpus = known.select("fact_id", "vector")
    if index is not None:
        hits = index.search(q, k, max(1, len(index.centre) // 8))
    else:
        hits = top_k_cells(q, corpus, k, cells=cells, probes=max(1, cells // 8)) if cells else top_k(q, corpus, k, query_rows=QUESTION_ROWS)
    return gather(hits, known.select("fact_id", "fact"))


def semantic_search(questions: DataFrame, facts: DataFrame, k: int = 20, encoder: Encoder | None = None, only: DataFrame | None = None, cells: int | None = None) -> DataFrame:
    """Encodes facts (line_no, fact) and searches them, as ``search_vectors``; equal questions are searched and equal facts compared once.

    Of equal facts, which score alike, the ``k`` with the smallest ids are all that can be among a question's best, and a text that is
    among them is among the ``k`` best texts by score and smallest id."""
    same = W.partitionBy("fact")
    kept = rank_in(facts.select(F.col("line_no").alias("fact_id"), "fact"), ["fact"], [F.asc("fact_id")], k, "copy")
    kept = stored(kept.withColumn("text_id", F.min("fact_id").over(same)))
    asked = questions if only is None else questions.join(only.select("quid"), "quid", "left_semi")
    asked = asked.select("quid", F.coalesce("question", F.lit("")).alias("question"))
    asked = stored(asked.withColumn("asked_id", F.min("quid").over(W.partitionBy("question"))))
    known = fact_vectors(kept.where("copy = 1").select(F.col("fact_id").alias("line_no"), "fact"), encoder)
    hits = search_vectors(asked.where("quid = asked_id"), known, k, encoder, cells=cells).select(F.col("quid").alias("asked_id"), F.col("fact_id").alias("text_id"), "score")
    best = rank_in(hits.join(kept.select("text_id", "fact_id", "fact"), "text_id"), ["asked_id"], [F.desc("score"), F.asc("fact_id")], k)
    return asked.select("quid", "asked_id").join(best, "asked_id").select("quid", "rank", "fact_id", "score", "fact")
