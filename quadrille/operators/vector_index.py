"""A kept inverted file of vectors, and a kept store of text vectors.

The index is a Parquet table partitioned by cell; a vector's row has its id, a code of one byte a dimension around the
cell's centre, the code's error, the distance from the centre, and the vector itself.  A search reads the small columns of
the cells that it needs (other cells are pruned as partitions), and the vectors of the few rows that the codes leave.
Codes bound scores from both sides, so what a search returns is exact over the cells that it looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_scope, stored
from .ground import rank_in

ENTRIES = "fact_id long, code binary, scale float, error float, away float, vector array<float>, cell int"
#: Candidates that are broadcast to the vectors they name: at most so many rows of about 24 bytes.
BROADCAST_ROWS = 1_000_000
#: At most so many scores are held at a time.
SCORES = 1_000_000
#: Rows (query, cell) that a frame holds, each with the query's vector.
ASKED_ROWS = 16_384


def cell_centres(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Centres of k-means cells, fitted on about ``sample`` vectors drawn by a hash of their ids."""
    n = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "fact_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))
    rows = drawn.select("fact_id", "vector").orderBy("fact_id").collect() or vectors.orderBy("fact_id").limit(cells).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in rows], float)
    centre = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        own = np.argmax(_near(x, centre), axis=1)
        total, count = np.zeros_like(centre), np.bincount(own, minlength=len(centre))
        np.add.at(total, own, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def _near(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return x @ centre.T - 0.5 * (centre * centre).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    """In four bytes, rounded up."""
    half = x.astype(np.float32)
    return np.where(half < x, np.nextafter(half, np.float32(np.inf)), half)


def _coded(vectors: DataFrame, centre: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["vector"].to_list()).astype(float)
                cell = np.argmax(_near(x, shared.value), axis=1)
                rest = x - shared.value[cell]
                scale = _up(np.abs(rest).max(axis=1) / 127)
                code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                error = np.linalg.norm(rest - scale[:, None].astype(float) * code, axis=1)
                yield pd.DataFrame({
                    "fact_id": b["fact_id"], "code": [c.tobytes() for c in code], "scale": scale, "error": _up(error), "away": _up(np.linalg.norm(rest, axis=1)),
                    "vector": b["vector"], "cell": cell.astype(np.int32),
                })

    return vectors.where("vector is not null and fact_id is not null").select("fact_id", "vector").mapInPandas(run, ENTRIES)


class VectorIndex:
    """The index at ``path``, which may be remote.  Made by ``build``; ``add`` takes what it lacks, ``search`` reads it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/_centres").orderBy("cell").collect()
        self.centre = np.array([r.centre for r in rows], float)

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 64, centres: np.ndarray | None = None) -> VectorIndex:
        """A new index of ``vectors`` (fact_id, vector); null vectors are left out."""
        spark = vectors.sparkSession
        centre = cell_centres(vectors.where("vector is not null"), cells) if centres is None else centres
        spark.createDataFrame([(i, c) for i, c in enumerate(centre.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/_centres")
        index = VectorIndex(spark, path)
        index._append(vectors)
        return index

    def _append(self, vectors: DataFrame) -> int:
        """Writes vectors to their cells and sizes the cells anew; returns how many rows the index has."""
        rows = _coded(vectors, self.centre) if len(self.centre) else self.spark.createDataFrame([], ENTRIES)
        rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(self.path)
        sizes = self.entries().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_cells")
        return int(self.sizes()[0].sum())

    def add(self, vectors: DataFrame) -> int:
        """Appends the vectors whose ids the index lacks to their cells; returns how many.  Safe to repeat.

        Only ids are read of what is there.  Centres stay as they are: bounds follow the data, so results stay exact."""
        before = int(self.sizes()[0].sum())
        return self._append(vectors.join(self.entries().select("fact_id"), "fact_id", "left_anti")) - before

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(self.path)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and radius of each cell."""
        n, radius = np.zeros(len(self.centre), np.int64), np.full(len(self.centre), -np.inf)
        for r in self.spark.read.schema("cell int, n long, away float").parquet(f"{self.path}/_cells").collect():
            n[r.cell], radius[r.cell] = r.n, r.away
        return n, radius

    def search(self, queries: DataFrame, k: int = 20, probes: int = 16, exact: bool = True, query_rows: int = 16_384, corpus_rows: int = 65_536) -> DataFrame:
        """(quid, rank, fact_id, score): the ``k`` best of each query (quid, vector) by inner product, ties to the smaller id.

        A query meets its ``probes`` nearest cells and, if ``exact``, then every other cell that may hold one of its best: no vector
        of a cell scores above query . centre + |query| * radius.  A cell's rows and the queries that ask it meet in blocks of bounded
        size; a cell's rows are copied only where more than ``query_rows`` queries ask it.  Queries without a vector have no rows."""
        asked = stored(queries.where("quid is not null and vector is not null").select("quid", "vector"))
        n, radius = self.sizes()
        if not n.any():
            return self.spark.createDataFrame([], "quid long, rank int, fact_id long, score double")
        found = stored(self._meet(asked, n, radius, k, probes, None, query_rows, corpus_rows))
        if exact:
            least = self._least(found, k)
            further = self._meet(asked.join(least, "quid", "left"), n, radius, k, probes, "least", query_rows, corpus_rows)
            found = stored(found.unionAll(further))
        kept = found.join(self._least(found, k), "quid", "left").where("least is null or upper >= least").select("quid", "cell", "fact_id")
        return self._scored(stored(kept), asked, k)

    def _least(self, found: DataFrame, k: int) -> DataFrame:
        """(quid, least): a score that each query's k-th best cannot be below."""
        return rank_in(found.select("quid", "fact_id", "lower"), ["quid"], [F.desc("lower")], k).where(F.col("rank") == k).select("quid", F.col("lower").alias("least"))

    def _meet(self, queries: DataFrame, n: np.ndarray, radius: np.ndarray, k: int, probes: int, least: str | None, query_rows: int, corpus_rows: int) -> DataFrame:
        """(quid, cell, fact_id, lower, upper): rows that may be among the k best, with bounds of their scores."""
        spark = self.spark
        shared = spark.sparkContext.broadcast((self.centre, n > 0, radius))

        asked = stored(queries.mapInPandas(_asking(shared, probes, least), "quid long, vector array<float>, least double, cell int"))
        # One row a cell, of which there are a bounded number.
        here = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        shape = spark.createDataFrame([(c, int(-(-n[c] // corpus_rows)), int(-(-m // query_rows))) for c, m in here.items()], "cell int, blocks int, askers int")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        upto = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
        q = asked.join(F.broadcast(shape), "cell").select("quid", "vector", "least", "cell", F.pmod(F.xxhash64("quid"), F.col("askers")).cast("int").alias("qb"), upto("blocks").alias("cb"))
        c = self.entries().where(F.col("cell").isin(sorted(here))).join(F.broadcast(shape), "cell")
        c = c.select("fact_id", "code", "scale", "error", "cell", F.pmod(F.xxhash64("fact_id"), F.col("blocks")).cast("int").alias("cb"), upto("askers").alias("qb"))
        keys = ["cell", "cb", "qb"]
        return q.repartition(parts, *keys).groupBy(*keys).cogroup(c.repartition(parts, *keys).groupBy(*keys)).applyInPandas(_candidates(shared, k), "quid long, cell int, fact_id long, lower double, upper double")

    def _scored(self, kept: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The candidates' true scores, ranked; vectors of other rows do not move."""
        small = kept.count() <= BROADCAST_ROWS
        cells = sorted(r.cell for r in kept.select("cell").distinct().collect())
        rows = self.entries().where(F.col("cell").isin(cells)).select("cell", "fact_id", F.col("vector").alias("own"))
        met = rows.join(F.broadcast(kept) if small else kept, ["cell", "fact_id"]).join(queries, "quid")
        score = F.aggregate(F.zip_with("vector", "own", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        return rank_in(met.select("quid", "fact_id", score.alias("score")), ["quid"], [F.desc("score"), F.asc("fact_id")], k).select("quid", "rank", "fact_id", "score")


def _asking(shared, probes: int, least: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Queries with each cell that they ask, in frames of at most ``ASKED_ROWS`` rows: a query may ask every cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, filled, radius = shared.value
        step = max(1, ASKED_ROWS // max(1, len(centre)))
        for batch in batches:
            for i in range(0, len(batch), step):
                b = batch.iloc[i : i + step]
                x = np.stack(b["vector"].to_list()).astype(float)
                near = np.where(filled, _near(x, centre), -np.inf)
                wanted = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1) < probes
                if least:
                    low = b["least"].to_numpy(float)[:, None]
                    bound = x @ centre.T + np.linalg.norm(x, axis=1)[:, None] * radius
                    wanted = ~wanted & (np.isnan(low) | (bound >= low - 1e-9 * (1 + np.abs(np.nan_to_num(low)))))
                row, cell = np.nonzero(wanted & filled)
                yield pd.DataFrame({"quid": b["quid"].to_numpy()[row], "vector": b["vector"].to_numpy()[row], "least": (b["least"].to_numpy(float) if least else np.full(len(b), np.nan))[row], "cell": cell.astype(np.int32)})

    return run


def _candidates(shared, k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"quid": pd.Series(dtype="int64"), "cell": pd.Series(dtype="int32"), "fact_id": pd.Series(dtype="int64"), "lower": pd.Series(dtype="float64"), "upper": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return none
        x, ids, error = np.stack(a["vector"].to_list()).astype(float), b["fact_id"].to_numpy(np.int64), b["error"].to_numpy(float)
        code = np.frombuffer(b"".join(b["code"]), np.int8).reshape(len(ids), -1)
        y = (shared.value[0][int(key[0])] + b["scale"].to_numpy(float)[:, None] * code).T
        given, size = np.nan_to_num(a["least"].to_numpy(float), nan=-np.inf), np.linalg.norm(x, axis=1)
        out, step = [none], max(1, SCORES // len(ids))
        for i in range(0, len(x), step):
            score = x[i : i + step] @ y
            slack = size[i : i + step, None] * error + 1e-9 * (1 + np.abs(score))
            lower = score - slack
            least = given[i : i + step]
            if len(ids) >= k:
                least = np.maximum(least, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
            row, col = np.nonzero(score + slack >= least[:, None])
            out.append(pd.DataFrame({"quid": a["quid"].to_numpy(np.int64)[i + row], "cell": np.int32(key[0]), "fact_id": ids[col], "lower": lower[row, col], "upper": (score + slack)[row, col]}))
        return pd.concat(out)

    return run


def search_once(queries: DataFrame, vectors: DataFrame, path: str, k: int, cells: int, probes: int, centres: np.ndarray | None = None, **blocks: int) -> DataFrame:
    """Builds an index at ``path`` and searches it."""
    return VectorIndex.build(vectors, path, cells, centres).search(queries, k, probes, **blocks)


def kept_vectors(texts: DataFrame, text_col: str, path: str, encoder_name: str, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``texts`` with a column vector from the store at ``path``, and how many different texts had to be encoded.

    The store has a row (key, vector) for each text that an encoder of that name has met, key being the text's SHA-256; it
    only grows.  ``encode`` maps (key, text) to (key, text, vector) and sees only texts that the store lacks, each once.  A null text is
    encoded as empty.  Encoders that differ must differ in name."""
    spark = texts.sparkSession
    keyed = texts.withColumn("text_key_", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    wanted = keyed.groupBy(F.col("text_key_").alias("key")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    where = f"{path}/encoder={encoder_name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(where)
    known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    schema = "key string, vector array<float>"
    new = wanted.join(spark.read.schema(schema).parquet(where).select("key"), "key", "left_anti") if known else wanted
    with scratch_scope():
        new = stored(new)
        fresh = new.count()
        encode(new).select("key", "vector").write.mode("append").parquet(where)
    vectors = spark.read.schema(schema).parquet(where).dropDuplicates(["key"])
    return keyed.join(vectors, keyed["text_key_"] == vectors["key"]).drop("text_key_", "key"), fresh
