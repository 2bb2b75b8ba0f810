"""Language identification of mixed texts: script ranges, per-word scores, Viterbi spans.

Training counts hashed character trigrams of words per language.  A word's score in a language is
the sum of its trigrams' log probabilities.  Its script (of its letters) leaves only languages
that use that script.  The best labelling of a text's words, where a change of language
between neighbours costs ``penalty``, gives its spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import free_name

UNDETERMINED = "und"

# First code points of the script ranges that are told apart; between them and
# before the first lies "other".
SCRIPT_STARTS = [
    (0x0041, "Latin"), (0x02B0, "other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index("other"), *[SCRIPTS.index(s) for _, s in SCRIPT_STARTS]], np.int8)


@dataclass(frozen=True)
class LangParams:
    #: Trigram counts are kept in so many buckets.
    buckets: int = 1 << 15
    #: About so many labelled documents of each language train the scores.
    sample: int = 3000
    #: What a change of language between two words costs, in nats.
    penalty: float = 12.0
    smoothing: float = 0.5
    #: More different languages are an error: the model is ``buckets`` numbers for each, and is broadcast.
    most_languages: int = 1000
    #: A language uses a script from this share of its training letters on.
    script_share: float = 0.01
    chunk: int = 1 << 19


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark (which belongs to the letters beside it), else 0."""
    if not _table:
        _table.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.int8))
    return _table[0]


class _Words:
    """A run of texts: code points, each word's end, letters and script, and trigram buckets.

    A word is a maximal run of letters and marks with a letter in it; everything else parts words."""

    def __init__(self, texts: list[str], buckets: int):
        joined = " ".join(texts).lower() + " "
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        kind = _letters()[np.minimum(cp, 0x10FFFF)]
        letter = kind > 0
        lengths = np.array([len(t.lower()) for t in texts]) + 1
        first = letter & ~np.concatenate([[False], letter[:-1]])
        last = letter & ~np.concatenate([letter[1:], [False]])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            full = np.maximum.reduceat(kind, start) == 2
            if not full.all():  # runs of marks alone are no words
                letter = letter.copy()
                letter[letter] = full[(np.cumsum(first) - 1)[letter]]
                start, end = start[full], end[full]
        self.start, self.end = start, end
        self.at = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(lengths)]))
        x = np.where(letter, cp, 0).astype(np.uint64)
        before, after = np.concatenate([[np.uint64(0)], x[:-1]]), np.concatenate([x[1:], [np.uint64(0)]])
        h = before * np.uint64(0x9E3779B1) + x * np.uint64(0x85EBCA77) + after * np.uint64(0xC2B2AE3D)
        h ^= h >> np.uint64(15)
        h *= np.uint64(0x2C1B3C6D)
        self.bucket = ((h >> np.uint64(12)) & np.uint64(buckets - 1)).astype(np.int32)
        self.letter = letter
        self.script = _SCRIPT[np.searchsorted(_STARTS, cp[self.start], side="right")]


def _runs(texts: list[str | None], chunk: int) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= chunk):
            size += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


@dataclass
class LangModel:
    """Log probabilities [bucket, language], scripts allowed [script, language], languages."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    params: LangParams

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """The language index of each word of each text, on its best path."""
        w = _Words(texts, self.params.buckets)
        return [p for p, _ in self._paths(w)]

    def _word_scores(self, w: _Words) -> np.ndarray:
        k, n = len(self.languages), len(w.start)
        out = np.zeros((n, k))
        at = np.flatnonzero(w.letter)
        edge = np.searchsorted(at, w.start)
        for j in range(k if n else 0):
            out[:, j] = np.add.reduceat(self.scores[w.bucket[at], j], edge)
        # Other scripts' languages are out, unless no language uses this script.
        free = self.allowed.copy()
        free[~free.any(axis=1)] = True
        out[~free[w.script]] = -1e4
        return out

    def _paths(self, w: _Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        s = self._word_scores(w)
        n, k = s.shape
        at, pen = w.at, self.params.penalty
        texts = len(at) - 1
        owner = np.repeat(np.arange(texts), np.diff(at))
        total = np.zeros((texts, k))
        if n:
            filled = np.flatnonzero(np.diff(at))
            total[filled] = np.add.reduceat(s, at[:-1][filled], axis=0)
        best = total.argmax(axis=1)
        # A one-language labelling is the best path if no run of words gains more than the penalty
        # in another language: the largest gain of a run is that of prefix sums over their least.
        open_ = np.zeros(texts, bool)
        if n:
            base = s[np.arange(n), best[owner]]
            step = 1e6 + 4e4 * float(np.diff(at).max())
            for j in range(k):
                prefix = np.cumsum(s[:, j] - base)
                head = np.concatenate([[0.0], prefix])[at[:-1]]
                local = prefix - head[owner]
                shifted = np.minimum(np.concatenate([[0.0], local[:-1]]), 0) if n else local
                shifted[at[:-1][np.diff(at) > 0]] = 0.0
                low = np.minimum.accumulate(shifted - owner * step) + owner * step
                open_[np.unique(owner[local - low > pen])] = True
        for t in range(texts):
            own = s[at[t] : at[t + 1]]
            yield (viterbi(own, pen) if open_[t] else np.full(len(own), best[t])), own


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best labelling of rows ``s`` [word, language], ``penalty`` a change; ties to the smaller index."""
    n, k = s.shape
    back = np.zeros((n, k), np.int16)
    d = s[0].copy()
    stay = np.arange(k)
    for t in range(1, n):
        j = int(d.argmax())
        jump = d[j] - penalty > d
        back[t] = np.where(jump, j, stay)
        d = np.where(jump, d[j] - penalty, d) + s[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(d.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train_languages(labelled: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """Trains on rows (doc_id, text, lang); a null text or lang teaches nothing.

    Every language with labelled rows is learned.  About ``sample`` rows of each are drawn by a
    hash of doc_id and text (the documented bound); counts are summed on executors, and the driver
    receives at most ``buckets`` counts a language."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(params.most_languages + 1).collect()}
    if len(sizes) > params.most_languages:
        raise ValueError(f"more than {params.most_languages} different languages")
    languages = sorted(sizes)
    if not languages:
        return LangModel([], np.zeros((params.buckets, 0)), np.zeros((len(SCRIPTS), 0), bool), params)
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(x, i, min(1.0, params.sample / sizes[x])) for i, x in enumerate(languages)], "lang string, l int, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("l", "text")
    buckets = params.buckets

    def count(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                label = batch.column("l").to_numpy()
                texts = batch.column("text").to_pylist()
                for l in np.unique(label):
                    grams, scripts = np.zeros(buckets, np.int64), np.zeros(len(SCRIPTS), np.int64)
                    for _, part in _runs([texts[i] for i in np.flatnonzero(label == l)], params.chunk):
                        w = _Words(part, buckets)
                        grams += np.bincount(w.bucket[w.letter], minlength=buckets)
                        scripts += np.bincount(w.script, weights=w.end - w.start, minlength=len(SCRIPTS)).astype(np.int64)
                    key = np.concatenate([np.flatnonzero(grams), buckets + np.flatnonzero(scripts)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), l, np.int32)), pa.array(key.astype(np.int32)), pa.array(np.concatenate([grams, scripts])[key])], ["l", "k", "n"])

    counts = drawn.mapInArrow(count, "l int, k int, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((buckets + len(SCRIPTS), len(languages)))
    table[counts["k"].to_numpy(), counts["l"].to_numpy()] = counts["n"].to_numpy()
    grams, scripts = table[:buckets] + params.smoothing, table[buckets:]
    scores = np.log(grams) - np.log(grams.sum(axis=0))
    allowed = scripts >= params.script_share * np.maximum(scripts.sum(axis=0), 1)
    return LangModel(languages, scores, allowed, params)


def _predict(m: LangModel, texts: list[str]) -> Iterator[tuple[str, float, np.ndarray]]:
    """(language, share of letters, word labels) of each text."""
    if not m.languages:
        yield from ((UNDETERMINED, 0.0, np.zeros(0, np.int64)) for _ in texts)
        return
    w = _Words(texts, m.params.buckets)
    for t, (path, _) in enumerate(m._paths(w)):
        if not len(path):
            yield UNDETERMINED, 0.0, path
            continue
        letters = np.bincount(path, weights=(w.end - w.start)[w.at[t] : w.at[t + 1]], minlength=len(m.languages))
        k = int(letters.argmax())
        yield m.languages[k], float(letters[k] / letters.sum()), path


def _span_edges(path: np.ndarray) -> list[tuple[int, int]]:
    if not len(path):
        return []
    edge = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def identify(docs: DataFrame, model: LangModel, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) for every row of ``docs`` (doc_id, text).

    * lang_pred: the language with most letters on the best path (ties: the smaller by code point);
      ``und`` with score 0 for a null text, one without letters, or a model without languages;
    * score: the share of the text's letters in spans of that language, 0 to 1;
    * spans: (language, first word, words) in order, words being runs of letters.

    Only text is read for a prediction.  Repeated rows give repeated results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang:string,first:int,words:int>>" if spans else "")

    def run(batches):
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, part in _runs(batch.column("text").to_pylist(), m.params.chunk):
                    found = list(_predict(m, part))
                    cols = [batch.column("doc_id").slice(first, len(part)), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                    names = ["doc_id", "lang_pred", "score"]
                    if spans:
                        cut = [[{"lang": m.languages[p[a]], "first": a, "words": b - a} for a, b in _span_edges(p)] for _, _, p in found]
                        cols.append(pa.array(cut, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))))
                        names.append("spans")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def with_language(docs: DataFrame, model: LangModel) -> DataFrame:
    """All columns of ``docs`` and its lang_pred and lang_score (underscores added to taken names)."""
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                pred, score = [], []
                for _, part in _runs(batch.column(text_at).cast(pa.string()).to_pylist(), m.params.chunk):
                    for lang, share, _ in _predict(m, part):
                        pred.append(lang)
                        score.append(share)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=pa.schema([*batch.schema, pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
