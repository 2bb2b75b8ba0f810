"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The index is an inverted one over the words of the items' questions.  An item's threshold puts a pivot into its terms:
up to it, from the lightest on, the terms stay below the threshold by so much that a passage must have a fixed weight
of the heavier ones, so only these have postings.  Items stand in blocks, and a term keeps its largest weight in each
block that has it.  Every passage of every text is a query: block maxima of its terms bound the blocks they name, postings
the items of blocks whose bound is high enough, and only items that pass are scored with all their terms.
All passages of a batch go through these steps together.  A retrieved item counts as leaked if the passage's text repeats
enough of its question and of its answer in word order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .words import word_hashes

K1, B = 1.2, 0.75
#: About so many runs of postings are looked at together.
RUNS = 1 << 19


@dataclass(frozen=True)
class LeakParams:
    """``window`` words a passage, a new one every half of it; items whose question needs longer passages
    have an index of their own with windows twice, four times, … as long, so each stretch that may hold a question is
    within one passage.

    ``question`` and ``answer``: least shares of the item's question and answer words that
    one stretch of the text must repeat.  The items carry no mark between the two: the last 1 / ``answer_part``
    of an item is its answer.  ``shingle``: words in a row that count as repeated.  ``block`` items share a bound.
    An index is made of at most ``max_bytes`` of item text; more items are taken in several passes over the texts."""

    window: int = 256
    question: float = 0.75
    answer: float = 0.75
    answer_part: int = 4
    shingle: int = 5
    block: int = 16
    max_bytes: int = 32 << 20


def split_item(h: np.ndarray, part: int = 4) -> int:
    """How many of an item's words are its question: all but the last 1 / ``part``, or all of less than ``part`` words."""
    return len(h) - len(h) // part


def _width(n: int, shingle: int) -> int:
    """Words in a row that count as repeated in a part of n words: three quarters of a short one, so that one
    changed word at an end is borne."""
    return min(shingle, max(1, 3 * n // 4)) if n else 0


def _reach(n: int) -> int:
    """How far apart the first words of a stretch's shingles may be."""
    return n + n // 4


def _least_score(weight: np.ndarray, count: np.ndarray, missing: int) -> float:
    """The least sum of the weights of different words if ``missing`` positions of the question are not repeated:
    the words that are heaviest by position go, the last in part."""
    order = np.argsort(-(weight / count), kind="stable")
    before = np.concatenate([[0], np.cumsum(count[order])[:-1]])
    gone = np.clip((missing - before) / count[order], 0, 1)
    return float((weight[order] * (1 - gone)).sum())


def _up(x: np.ndarray) -> np.ndarray:
    """In two bytes, rounded up: bounds stay bounds."""
    half = x.astype(np.float16)
    return np.where(half < x, np.nextafter(half, np.float16(np.inf)), half)


class Index:
    """BM25 weights of the questions of some items: sparse postings by term and item for the terms behind the items'
    pivots, the largest weight of each run of a term's postings within a block, and each item's own terms.  Items stand in
    order of their thresholds, so blocks have like ones.

    A word of an item takes four bytes, a different one six more, a posting six, a run six, a term 24."""

    def __init__(self, ids: list[int], items: list[np.ndarray], params: LeakParams, window: int):
        n = len(items)
        self.params, self.window, self.n = params, window, n
        cuts = [split_item(x, params.answer_part) for x in items]
        self.hashes = np.unique(np.concatenate(items))
        lengths = np.array(cuts, float)
        words = [np.unique(np.searchsorted(self.hashes, x[:c]), return_counts=True) for x, c in zip(items, cuts, strict=True)]
        df = np.bincount(np.concatenate([w for w, _ in words]), minlength=len(self.hashes))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weights = [_up(idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / lengths.mean()))) for i, (w, tf) in enumerate(words)]
        need = np.array([_least_score(weights[i].astype(float), tf, int((1 - params.question) * cuts[i] + 1e-9)) for i, (_, tf) in enumerate(words)])
        turn = np.argsort(need, kind="stable")
        self.ids, self.cuts, self.need = [ids[i] for i in turn], [cuts[i] for i in turn], (need[turn] * 0.9999).astype(np.float32)
        self.items = [np.searchsorted(self.hashes, items[i]).astype(np.int32) for i in turn]
        self.own = [words[i][0].astype(np.int32) for i in turn]
        self.own_weight = [weights[i] for i in turn]
        # The pivot: the heaviest terms, up to a weight of which a quarter of the threshold cannot be missed.
        item, term, weight, self.behind = [], [], [], np.zeros(n, np.float32)
        for i in range(n):
            order = np.argsort(-self.own_weight[i].astype(float), kind="stable")
            upto = np.cumsum(self.own_weight[i][order].astype(float))
            missed = upto[-1] - self.need[i]
            k = min(len(order), int(np.searchsorted(upto, missed + 0.25 * self.need[i])) + 1)
            self.behind[i] = upto[k - 1] - missed
            item.append(np.full(k, i))
            term.append(self.own[i][order[:k]])
            weight.append(self.own_weight[i][order[:k]])
        item, term, weight = (np.concatenate(x) for x in (item, term, weight))
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order].astype(np.int32), weight[order]
        block = self.item // params.block
        edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.run, self.run_most, self.run_block = np.append(edge, len(term)).astype(np.int32), np.maximum.reduceat(self.weight, edge), block[edge].astype(np.int32)
        self.run_at = np.searchsorted(term[edge], np.arange(len(self.hashes) + 1)).astype(np.int32)
        self.least = np.minimum.reduceat(self.behind, np.arange(0, n, params.block))

    def nbytes(self) -> int:
        parts = (self.hashes, self.item, self.weight, self.run, self.run_most, self.run_block, self.run_at, self.need, self.behind, self.least, *self.items, *self.own, *self.own_weight)
        return sum(x.nbytes for x in parts) + 16 * self.n

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that is in no item."""
        place = np.searchsorted(self.hashes, h)
        place[place == len(self.hashes)] = 0
        return np.where(self.hashes[place] == h, place, -1)

    def retrieve(self, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all items that reach their threshold; passages are runs begin to end of ``numbers``."""
        held = np.flatnonzero(numbers >= 0)
        held = held[self.run_at[numbers[held] + 1] > self.run_at[numbers[held]]]
        owner, take = _ranges(np.searchsorted(held, begin), np.searchsorted(held, end))
        key = np.unique(owner * len(self.hashes) + numbers[held[take]])
        owner, term = key // len(self.hashes), key % len(self.hashes)
        low, high = self.run_at[term], self.run_at[term + 1]
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        step = np.cumsum(np.add.reduceat(high - low, start)) // RUNS if len(owner) else owner
        cuts = np.append(start[np.flatnonzero(np.diff(step, prepend=-1))], len(owner)) if len(owner) else owner
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for passage, i in zip(*self._candidates(owner[a:b], low[a:b], high[a:b]), strict=True):
                there = np.isin(self.own[i], numbers[begin[passage] : end[passage]])
                score = float(self.own_weight[i][there].astype(np.float64).sum())
                if score >= self.need[i]:
                    yield passage, i, score

    def _candidates(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[int]]:
        """(passages, items) whose terms behind the pivot reach the weight that they must have: blocks by the maxima
        of runs, then items by postings."""
        pick, run = _ranges(low, high)
        key = owner[pick] * len(self.least) + self.run_block[run]
        order = np.argsort(key, kind="stable")
        key, run = key[order], run[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bound = np.add.reduceat(self.run_most[run].astype(np.float64), edge)
        size = np.diff(np.append(edge, len(key)))
        good = np.repeat(bound >= self.least[key[edge] % len(self.least)] * 0.9999, size)
        key, run = key[good], run[good]
        if not len(key):
            return [], []
        pick, post = _ranges(self.run[run], self.run[run + 1])
        pair, inverse = np.unique(key[pick] // len(self.least) * self.n + self.item[post], return_inverse=True)
        weight = np.bincount(inverse, self.weight[post].astype(np.float64), len(pair))
        pair = pair[weight >= self.behind[pair % self.n] * 0.9999]
        return (pair // self.n).tolist(), (pair % self.n).tolist()


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers in the ranges low to high - 1."""
    size = (high - low).astype(np.int64)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low.astype(np.int64), size)


def _stretches(text: np.ndarray, part: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, shares): from each place where a shingle of ``part`` stands in ``text``, the share of part's
    positions that its shingles cover which stand in a stretch of about its own length from there.

    A window slides over the places.  A different shingle counts once, as long as it is within; when it comes or goes, its
    positions do, so the work is linear in the text also where words repeat.  Words are numbers, -1 for
    those that are in no item."""
    m, width = len(part), _width(len(part), shingle)
    if not m or len(text) < width:
        return np.zeros(0, np.int64), np.zeros(0)

    def grams(x: np.ndarray) -> np.ndarray:
        g = np.zeros(len(x) - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                g = (g + (x[k : k + len(g)].astype(np.int64) + 2).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return g

    want, have = grams(part), grams(text)
    kinds, kind = np.unique(want, return_inverse=True)
    place = np.minimum(np.searchsorted(kinds, have), len(kinds) - 1)
    at = np.flatnonzero(kinds[place] == have)
    if not len(at):
        return at, np.zeros(0)
    sort = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[sort], np.arange(len(kinds) + 1))
    covers: dict[int, np.ndarray] = {}
    count, cover, covered = defaultdict(int), np.zeros(m, np.int64), 0
    share, j, g = np.zeros(len(at)), 0, place[at].tolist()
    last = np.searchsorted(at, at + _reach(m), side="right")
    for i in range(len(at)):
        for j in range(j, int(last[i])):  # noqa: B020
            x = g[j]
            count[x] += 1
            if count[x] == 1:
                if x not in covers:
                    covers[x] = np.unique((sort[edge[x] : edge[x + 1]][:, None] + np.arange(width)).reshape(-1))
                covered += int((cover[covers[x]] == 0).sum())
                cover[covers[x]] += 1
        j = int(last[i])
        share[i] = covered / m
        x = g[i]
        count[x] -= 1
        if not count[x]:
            cover[covers[x]] -= 1
            covered -= int((cover[covers[x]] == 0).sum())
    return at, share


def _overlap(words: np.ndarray, item: np.ndarray, cut: int, p: LeakParams) -> tuple[float, float] | None:
    """Question and answer share of the best pair of stretches that reach both thresholds, the answer's beginning
    at most an item's length before the question's or two behind it; None if there is no such pair."""
    at, q = _stretches(words, item[:cut], p.shingle)
    at, q = at[q >= p.question], q[q >= p.question]
    if not len(at):
        return None
    if cut == len(item):
        return float(q.max()), 1.0
    there, r = _stretches(words, item[cut:], p.shingle)
    low, high = np.searchsorted(there, at - len(item)), np.searchsorted(there, at + 2 * len(item), side="right")
    best = None
    for i in np.argsort(-q, kind="stable").tolist():
        if best and q[i] + 1 <= sum(best):
            break
        most = float(r[low[i] : high[i]].max()) if high[i] > low[i] else 0.0
        if most >= p.answer and (best is None or q[i] + most > sum(best)):
            best = (float(q[i]), most)
    return best


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashed words of texts in lower case, without the signs around them."""
    return word_hashes(pc.utf8_lower(column), bare=True)


def _window(words: int, p: LeakParams) -> int:
    """The passage length, of the doubled ones, half of which holds any stretch for a question of so many words."""
    window = p.window
    while window // 2 < _reach(words) + p.shingle:
        window *= 2
    return window


def _build(ids: list[int], texts: list[str], params: LeakParams) -> list[Index]:
    """An index for each passage length that the items need."""
    items: list[np.ndarray] = []
    for _, h, at in _words(pa.array(texts, pa.string())):
        items += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    by_window = defaultdict(list)
    for i, x in zip(ids, items, strict=True):
        if len(x) and i is not None:
            by_window[_window(split_item(x, params.answer_part), params)].append((i, x))
    return [Index([i for i, _ in some], [x for _, x in some], params, w) for w, some in sorted(by_window.items())]


def _hits(h: np.ndarray, at: np.ndarray, indexes: list[Index], p: LeakParams) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item id, score, question share, answer share) of confirmed leaks."""
    words = np.diff(at)
    for index in indexes:
        stride = index.window // 2
        n_pass = np.where(words > 0, 1 + np.maximum(0, -(-(words - index.window) // stride)), 0)
        total = int(n_pass.sum())
        if not total:
            continue
        text_of, number = _ranges(np.zeros(len(words), np.int64), n_pass)
        begin = at[text_of] + number * stride
        end = np.minimum(begin + index.window, at[text_of + 1])
        numbers = index.numbers(h)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for passage, i, score in index.retrieve(numbers, begin, end):
            t, item = int(text_of[passage]), index.items[i]
            span = numbers[max(int(begin[passage]) - len(item), int(at[t])) : min(int(end[passage]) + 2 * len(item) + p.shingle, int(at[t + 1]))]
            overlap = _overlap(span, item, index.cuts[i], p)
            if overlap and ((t, i) not in found or (sum(overlap), score) > (sum(found[t, i][1:]), found[t, i][0])):
                found[t, i] = (score, *overlap)
        for (t, i), (score, q, r) in sorted(found.items()):
            yield t, index.ids[i], score, q, r


def _indexes(benchmark: DataFrame, params: LeakParams) -> Iterator:
    """Broadcast indexes of the benchmark's parts of at most about ``max_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // params.max_bytes))
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        got = sorted((r.item_id, r.text) for r in mine.collect())
        yield benchmark.sparkSession.sparkContext.broadcast(_build([g[0] for g in got], [g[1] for g in got], params))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row for each text and leaked item.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text).  Null, empty or wordless texts and
    items take no part, nor do items without item_id; case and the signs around
    words do not matter.  A
    repeated text gives its rows again; a repeated item is an item of its own.  An empty
    benchmark gives no rows.  An item's threshold is the least score that a passage can have in which ``question`` of its
    question's words are repeated, so retrieval loses no leak; every passage that reaches it is verified.  The benchmark
    is read to the driver in parts of ``max_bytes`` of text, each part one pass over ``docs``; an index is about two
    and a half times as large as its text, which bounds what an executor holds."""
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _indexes(benchmark, params):

        def run(batches, shared=shared):
            with np.errstate(over="ignore"):
                for batch in batches:
                    for first, h, at in _words(batch.column("text")):
                        found = list(_hits(h, at, shared.value, params))
                        if found:
                            ids = batch.column("doc_id").take(pa.array([first + f[0] for f in found]))
                            cols = [pa.array([f[j] for f in found], kind) for j, kind in enumerate([pa.int64(), pa.float64(), pa.float64(), pa.float64()], 1)]
                            yield pa.RecordBatch.from_arrays([ids, *cols], names)

        hits = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.unionAll(hits)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` whose text repeats no item, with all their columns; each row is judged by its own text,
    whatever its doc_id, and none is shuffled.  Null, empty or wordless texts stay."""
    text_at = [c.lower() for c in docs.columns].index("text")
    out = docs
    for shared in _indexes(benchmark, params):

        def run(batches, shared=shared):
            with np.errstate(over="ignore"):
                for batch in batches:
                    keep = np.ones(batch.num_rows, bool)
                    for first, h, at in _words(batch.column(text_at).cast(pa.string())):
                        keep[[first + f[0] for f in _hits(h, at, shared.value, params)]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
