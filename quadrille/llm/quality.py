"""Quality scoring by co-training a text view and a metadata view.

Two classifiers see different sides of a document: its words and style, and its source,
language tag and length.  Both learn from labelled documents.  Over some rounds each scores a
pool of unlabelled documents and hands its most confident ones, with its own labels, to
the other.  Then each view is calibrated on labelled documents kept aside, a logistic
combination of the calibrated views is fitted there, and all documents are scored.
The same is done for toxicity; a document is kept if it is good and not toxic.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .session import checkpointed, discard
from .words import _pieces, hashes, mix, spans, text_bytes, trimmed

TARGETS = ("good", "toxic")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[33, 44, 46, 58, 59, 63, 34, 39]] = True
_SIGN = ~_LETTER & ~_DIGIT & ~_END
_SIGN[[0x20, *range(9, 14)]] = False
STYLE_BINS = 12


@dataclass(frozen=True)
class QualityParams:
    #: The documented bounds: about so many labelled rows train, so many unlabelled ones are the pool.
    labelled: int = 8000
    pool: int = 4000
    buckets: int = 1 << 16
    rounds: int = 3
    #: Pseudo-labels a view gives per round and class, and the probability they need.
    given: int = 200
    confident: float = 0.97
    ridge: float = 3e-4
    steps: int = 150
    keep_good: float = 0.5
    keep_toxic: float = 0.2


def _text_view(raw: np.ndarray, at: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each text the sorted distinct feature numbers: hashed words without the signs around
    them, then style measures in bins."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(at) - 1)
    style: dict[int, np.ndarray] = {}
    for i, j, part, offsets in _pieces(raw, at):
        start, end = spans(part, offsets)
        edge = np.searchsorted(start, offsets)
        start, end = trimmed(part, start, end)
        number = (hashes(part, start, end) % np.uint64(buckets)).astype(np.int64)
        sums = []
        for kind in (_LETTER, _UPPER, _DIGIT, _END, _SIGN):
            total = np.concatenate([[0], np.cumsum(kind[part], dtype=np.int64)])
            sums.append(np.diff(total[offsets]))
        sums += [np.diff(offsets), np.diff(edge)]
        for t in range(i, j):
            own = np.unique(number[edge[t - i] : edge[t - i + 1]])
            measure = np.array([s[t - i] for s in sums])
            if t in style:
                out[t], style[t] = np.union1d(out[t], own), style[t] + measure
            else:
                out[t], style[t] = own, measure
    for t, (letters, upper, digits, ends, signs, size, words) in style.items():
        parts = [upper / max(letters, 1), digits / max(size, 1), ends / max(words, 1), signs / max(size, 1), len(out[t]) / max(words, 1), letters / max(words, 1) / 20, np.log1p(words) / 12]
        bins = [buckets + k * STYLE_BINS + min(STYLE_BINS - 1, int(p**0.5 * STYLE_BINS)) for k, p in enumerate(parts)]
        out[t] = np.concatenate([out[t], np.array(bins, np.int64)])
    return out


TEXT_STYLES = 7
META_BUCKETS = 1 << 10


def _meta_view(source: list, lang: list, n_chars: list) -> list[np.ndarray]:
    """Hashed source, language and length class, and their pairs; a null is a value of its own."""

    def number(*x) -> int:
        raw = "\x1f".join(map(repr, x)).encode()
        h = int.from_bytes(raw[:8].ljust(8, b"\0"), "little")
        for k in range(8, len(raw), 8):
            h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(raw[k : k + 8].ljust(8, b"\0"), "little")) & ((1 << 64) - 1)
        return int(mix(np.array([h], np.uint64))[0] % np.uint64(META_BUCKETS))

    known: dict[tuple, np.ndarray] = {}
    out = []
    for s, l, n in zip(source, lang, n_chars, strict=True):
        c = None if n is None else max(0, int(n)).bit_length()
        if (s, l, c) not in known:
            known[s, l, c] = np.unique([number("s", s), number("l", l), number("n", c), number("sl", s, l), number("ln", l, c)])
        out.append(known[s, l, c])
    return out


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.index], self.n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_view(rows: list[np.ndarray], y: np.ndarray, size: int, params: QualityParams) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression whose features are scaled
    by the log ratio of their frequencies in both classes."""
    x = _Rows(rows)
    pos, neg = np.bincount(x.index, y[x.owner], size) + 1, np.bincount(x.index, 1 - y[x.owner], size) + 1
    ratio = np.log(pos / (y.sum() + 2)) - np.log(neg / ((1 - y).sum() + 2))
    scale = ratio * np.minimum(1, np.sqrt((pos + neg - 2) / 5))
    w, b, m, speed = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, params.steps + 1):
        r = _sigmoid(x.dot(w * scale) + b) - y
        g = np.concatenate([np.bincount(x.index, r[x.owner], size) * scale / x.n + params.ridge * w, [r.mean()]])
        m, speed = 0.9 * m + 0.1 * g, 0.99 * speed + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.concatenate([w * scale, [b]])


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on columns z by Newton steps with a little ridge; slopes, then intercept.
    A column with a negative slope is left out (slope 0)."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (t - p) - 1e-2 * w)
        w = w + np.clip(move, -5, 5)
    use = w[:-1] > 0
    if not use.all():
        w[:-1] = 0.0
        if use.any():
            w[np.append(use, True)] = _platt(z[:, use], y)
        else:
            w[-1] = np.log(t.mean() / (1 - t.mean()))
    return w


@dataclass
class QualityModel:
    #: By target: weights of both views, each view's calibration, and how they are combined.
    text: dict[str, np.ndarray]
    meta: dict[str, np.ndarray]
    calibration: dict[str, tuple[np.ndarray, np.ndarray]]
    combination: dict[str, np.ndarray]
    params: QualityParams
    exchanged: dict[str, list[int]]

    def score(self, target: str, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        if target not in self.text:
            return np.full(len(text), float(self.combination[target][0]))
        z = [_Rows(rows).dot(w[:-1]) + w[-1] for rows, w in ((text, self.text[target]), (meta, self.meta[target]))]
        z = [zi * c[0] + c[1] for zi, c in zip(z, self.calibration[target], strict=True)]
        c = self.combination[target]
        return _sigmoid(z[0] * c[0] + z[1] * c[1] + c[2])


def cotrain(target: str, text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, pool_text: list[np.ndarray], pool_meta: list[np.ndarray], params: QualityParams) -> QualityModel:
    """Co-trains both views on one target; a fifth of the labelled rows, drawn by a seed, is kept aside for calibration.

    Without rows of both classes in the training part the base rate is the score."""
    size = params.buckets + TEXT_STYLES * STYLE_BINS
    n = len(text)
    aside = np.random.default_rng(5).permutation(n) % 5 == 4
    model = QualityModel({}, {}, {}, {}, params, {})
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    if len(set(y[learn].tolist())) < 2:
        model.combination[target] = np.array([y.mean() if n else 0.5 if target == "good" else 0.0])
        return model
    views = ((text, pool_text, size), (meta, pool_meta, META_BUCKETS))
    extra: list[dict[int, float]] = [{}, {}]
    weights: list[np.ndarray] = []
    exchanged = []
    for turn in range(params.rounds + 1):
        weights = []
        for v, (own, pool, width) in enumerate(views):
            rows = [own[i] for i in learn] + [pool[i] for i in extra[v]]
            weights.append(fit_view(rows, np.concatenate([y[learn], list(extra[v].values())]), width, params))
        if turn == params.rounds or not pool_text:
            break
        for v, (_, pool, _) in enumerate(views):
            p = _sigmoid(_Rows(pool).dot(weights[v][:-1]) + weights[v][-1])
            other = extra[1 - v]
            rate = y[learn].mean()
            for value, sure, share in ((1.0, p, rate), (0.0, 1 - p, 1 - rate)):
                best = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= params.confident and i not in other]
                other.update({int(i): value for i in best[: max(1, round(2 * params.given * share))]})
        exchanged.append(len(extra[0]) + len(extra[1]))
    z = [_Rows([own[i] for i in check]).dot(weights[v][:-1]) + weights[v][-1] for v, (own, _, _) in enumerate(views)]
    calibration = tuple(_platt(zi[:, None], y[check]) for zi in z)
    both = np.stack([zi * c[0] + c[1] for zi, c in zip(z, calibration, strict=True)], axis=1)
    model.text[target], model.meta[target] = weights
    model.calibration[target] = calibration
    model.combination[target] = _platt(both, y[check])
    model.exchanged[target] = exchanged
    return model


def _columns(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    meta = [F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta)


def _views(batch: pa.RecordBatch, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw, at = text_bytes(batch.column("text"))
    meta = _meta_view(*[batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")])
    return _text_view(raw, at, buckets), meta


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Trains on ``docs`` with ``labels`` (doc_id, quality, toxic).

    Labels that repeat for a doc_id count as bad if one is and toxic if one is; null labels and
    labels of unknown documents are not used.  About ``labelled`` labelled and ``pool`` unlabelled
    documents are drawn by a hash of doc_id before their texts are shuffled.  Each target is trained by a task of
    its own, on that bounded sample; the driver gets the weights."""
    rows = _columns(docs).where("doc_id is not null and text is not null")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and good is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    known, total = marks.count(), rows.select("doc_id").count()

    def drawn(seed: int, wanted: int, of: int):
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(of, 1)))

    marked, unmarked = drawn(11, params.labelled, known), drawn(12, params.pool, total - known)
    met = rows.where(marked | unmarked).join(marks, "doc_id", "left")
    sample = met.where(F.when(F.col("good").isNull(), unmarked).otherwise(marked))
    buckets = params.buckets

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    some = batch.slice(k, 500)
                    text, meta = _views(some, buckets)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), pa.array([t.astype(np.int32).tobytes() for t in text], pa.binary()), pa.array([m.astype(np.int32).tobytes() for m in meta], pa.binary()), some.column("good"), some.column("toxic")],
                        ["doc_id", "t", "m", "good", "toxic"],
                    )

    found = checkpointed(sample.select("doc_id", "text", "source", "lang", "n_chars", "good", "toxic").mapInArrow(run, "doc_id long, t binary, m binary, good int, toxic int"))

    def arrays(column) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int32).astype(np.int64) for x in column]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "t"], kind="stable")
        own, pool = pdf[pdf["good"].notna()], pdf[pdf["good"].isna()]
        target = str(pdf["target"].iloc[0])
        model = cotrain(target, arrays(own["t"]), arrays(own["m"]), (own[target] > 0).to_numpy().astype(float), arrays(pool["t"]), arrays(pool["m"]), params)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    by_target = found.withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS]))).groupBy("target").applyInPandas(fit, "model binary")
    parts = [pickle.loads(bytes(r.model)) for r in by_target.collect()]
    discard(found)
    missing = [t for t in TARGETS if not any(t in p.combination for p in parts)]
    parts += [cotrain(t, [], [], np.zeros(0), [], [], params) for t in missing]
    merged = QualityModel({}, {}, {}, {}, params, {})
    for p in parts:
        for name in ("text", "meta", "calibration", "combination", "exchanged"):
            getattr(merged, name).update(getattr(p, name))
    return merged


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, good, toxic (probabilities), score = good * (1 - toxic), keep for every row of ``docs``.

    Whole texts are scored; a null text is an empty one.  source, lang and n_chars are metadata;
    a missing column or a null is a value of its own.  Repeated rows give repeated results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    some = batch.slice(k, 500)
                    text, meta = _views(some, m.params.buckets)
                    good, toxic = (m.score(t, text, meta) for t in TARGETS)
                    keep = (good >= m.params.keep_good) & (toxic < m.params.keep_toxic)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(good), pa.array(toxic), pa.array(good * (1 - toxic)), pa.array(keep)], ["doc_id", "good", "toxic", "score", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id long, good double, toxic double, score double, keep boolean")
