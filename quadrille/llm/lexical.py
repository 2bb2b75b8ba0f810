"""Ranked lexical search by Fagin's threshold algorithm.

Each part of the documents has a forward index (a document's terms with their impacts) and, for each term, a list of its
documents by falling impact.  An item walks the lists of its terms in turn; a document seen for the first time gets its
whole score by a look into the forward index.  No unseen document can score more than the sum of the impacts reached in
the lists; once that threshold is strictly below the kth score, the part is done.  A term of weight 0 (one that nearly all
documents have) adds nothing and has no list.

Parts are searched where they lie.  A first search for the best few of each part gives every item a score that its kth
document cannot be below, so that the second one stops early and yields little more than the final rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import checkpointed
from .words import text_bytes

#: ASCII letters and digits stand for themselves (A-Z in lower case), as do all bytes of other characters; the rest is space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHUNK_BYTES = 1 << 20
#: Postings that a task indexes at a time.
SEGMENT = 1 << 21
FIRST_STEP, LAST_STEP = 8, 1024
#: Best documents of a part that the first search takes for each item.
PILOT = 4
#: Text of items that are searched in one pass over the documents.
MAX_BYTES = 2 << 20
SALTS = 64


def text_terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, each of about ``CHUNK_BYTES``; no term is parted."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK_BYTES, len(raw))
        while end < len(raw) and TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(TERM_BYTES).split()
        at = end


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    raw, at = text_bytes(column)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield raw[i:j].tobytes()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with terms: its number of terms, and those in ``vocabulary`` with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shared.value
        for batch in batches:
            n, at, terms, tfs = [], [0], [], []
            for raw in _bytes_of(batch.column("text")):
                total, count = 0, Counter()
                for words in text_terms(raw):
                    total += len(words)
                    count.update(words)
                own = sorted((number[t], count[t]) for t in count.keys() & number.keys())
                terms += [t for t, _ in own]
                tfs += [c for _, c in own]
                n.append(total)
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


@dataclass
class Search:
    """Items by number with their distinct terms, the terms' weights, and what the corpus says of lengths."""

    items: list[np.ndarray]
    weight: np.ndarray
    n_docs: int
    length: int
    #: A score by item that the kth document cannot be below.
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some non-empty ranges, and where each range begins among them."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.repeat(start - first, size) + np.arange(int(size.sum())), first


class Segment:
    """Forward index and impact lists of some documents."""

    def __init__(self, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray, search: Search):
        if len(n) and 50 * int(n.max()) * search.n_docs >= 1 << 63:
            m = np.array([50 + 50 * x * search.n_docs // search.length for x in n.tolist()], np.int64)
        else:
            m = 50 + 50 * n * search.n_docs // search.length
        owner = np.repeat(np.arange(len(n)), np.diff(at))
        self.n, self.at, self.term = len(n), at, term
        self.impact = search.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
        self.weight = search.weight
        up = np.flatnonzero(self.impact > 0)
        order = up[np.lexsort((-self.impact[up], term[up]))]
        self.list_doc, self.list_impact = owner[order], self.impact[order]
        self.list_at = np.searchsorted(term[order], np.arange(len(search.weight) + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The whole scores of documents that have terms, looked up in the forward index."""
        places, first = _ranges(self.at[docs], self.at[docs + 1])
        return np.add.reduceat(np.where(wanted[self.term[places]], self.impact[places], 0), first)

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores (at least ``floor``) among which the k best are, and how many documents were looked up."""
        wanted = np.zeros(len(self.weight), bool)
        wanted[terms] = True
        start, end = self.list_at[terms], self.list_at[terms + 1]
        start, end = start[end > start], end[end > start]
        seen = np.zeros(self.n, bool)
        docs, scores, at, step, looked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], start, FIRST_STEP, 0
        while len(at):
            upto = np.minimum(at + step, end)
            met = np.unique(self.list_doc[_ranges(at, upto)[0]])
            met = met[~seen[met]]
            seen[met] = True
            looked += len(met)
            if len(met):
                score = self.scores(met, wanted)
                good = score >= floor
                docs.append(met[good])
                scores.append(score[good])
                if good.any():
                    docs, scores = [np.concatenate(docs)], [np.concatenate(scores)]
                    if len(scores[0]) >= k:
                        floor = max(floor, int(np.partition(scores[0], -k)[-k]))
                        docs, scores = [docs[0][scores[0] >= floor]], [scores[0][scores[0] >= floor]]
            going = upto < end
            if int(self.list_impact[upto[going] - 1].sum()) < floor:
                break
            at, end = upto[going], end[going]
            step = min(2 * step, LAST_STEP)
        return docs[0], scores[0], looked


def _segments(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[tuple[pa.Array, Segment]]:
    """The rows of a task as segments of about ``SEGMENT`` postings, with the documents' ids."""
    held: list[pa.RecordBatch] = []
    postings = 0

    def made():
        table = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        at = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
        arrays = (terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy())
        return table.column("doc_id").combine_chunks(), Segment(table.column("n").to_numpy(), at, *arrays, search)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= SEGMENT:
                yield made()
                held.clear()
                postings = 0
    if held:
        yield made()


def _search_parts(index: DataFrame, search: Search, k: int) -> DataFrame:
    """(item, doc_id, score): of each part the k best documents of each item and ties with the last, if they reach its floor."""
    shared = index.sparkSession.sparkContext.broadcast(search)

    def run(batches):
        search = shared.value
        floor = np.maximum(search.floor, 1)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in search.items]
        for ids, segment in _segments(batches, search):
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, terms in enumerate(search.items):
                docs, scores, _ = segment.best(terms, k, int(floor[i]))
                doc, score, none = (np.concatenate(x) for x in zip(best[i], (ids[docs], scores, null[docs]), strict=True))
                order = np.lexsort((doc, none, -score))[:k]
                best[i] = doc[order], score[order], none[order]
                if len(order) == k:
                    floor[i] = max(floor[i], score[order[-1]])
        size = [len(d) for d, _, _ in best]
        if sum(size):
            doc, score, none = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size).astype(np.int32)), pa.array(doc, mask=none), pa.array(score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each item with their rank; an item's rows are cut in ``SALTS`` parts first."""
    cut = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    cut = cut.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "salt")
    return cut.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _item_parts(items: DataFrame, max_bytes: int) -> Iterator[list[tuple]]:
    """The rows (item_id, text) with text, in parts of about ``max_bytes``."""
    rows = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    for p in range(parts):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, max_bytes: int = MAX_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of ``docs`` (doc_id, text) with the highest score above 0 for each row of
    ``items`` (item_id, text).

    * Terms are runs of characters other than ASCII signs, spaces and controls; only A-Z are lower-cased.
    * N documents have a term, L terms in all; w = floor(1000 ln((2N+2) / (2df+1))), m = 50 + 50nN div L; a document's score
      is the sum over the item's distinct terms of w * (10^9 tf div (1000 tf + 20 m)).
    * Equal scores go by doc_id, null last; every row is a document of its own, also where ids repeat.
    * A null or wordless item has no rows, nor has a null or wordless document; each row of ``items`` is ranked by itself, so an
      id that stands in two rows has two lists.
    * ``items`` come to the driver in parts of ``max_bytes`` of text (an item is whole), each a pass over ``docs``, which bounds what is broadcast:
      the part's terms, their document counts and its items.
    * Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    out: DataFrame | None = None
    for rows in _item_parts(items, max_bytes):
        own = [sorted({t for words in text_terms(text.encode()) for t in words}) for _, text in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for x in own for t in x}))}
        index = checkpointed(forward_index(docs, vocabulary))
        n_docs, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r.t: r.n for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
        weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        found = Search([np.array([vocabulary[t] for t in x if vocabulary[t] in df], np.int64) for x in own], weights, n_docs, max(1, length))
        found.floor = np.zeros(len(rows), np.int64)
        pilot = _ranked(_search_parts(index, found, PILOT), k, F.col("score").desc())
        for r in pilot.where(F.col("rank") == k).select("item", "score").collect():
            found.floor[r.item] = r.score
        ranked = _ranked(_search_parts(index, found, k), k, F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {id_type}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return out
