"""Ranked lexical search against exhaustive scoring."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import sentence

from quadrille.llm import lexical
from quadrille.llm.lexical import Search, Segment, rank_documents, text_terms, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exhaustive(docs, items, k=50):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    found = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    found = [(d, len(t), Counter(t)) for d, t in found if t]
    big_n, length, df = len(found), sum(n for _, n, _ in found), Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, n, c in found:
            m = 100 - 50 + 50 * n * big_n // length
            s = sum(weight(big_n, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=50, **params):
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k, **params)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 40)) + " the" * rng.randrange(4) for _ in range(n)]
    return list(enumerate(texts)), [(i, rng.choice(texts) + " the of") for i in range(12)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_equals_exhaustive_scores(spark, k):
    docs, items = corpus(k, 300)
    assert ranked(spark, docs, items, k) == exhaustive(docs, items, k)


def test_several_passes_and_segments(spark, monkeypatch):
    docs, items = corpus(5, 200)
    monkeypatch.setattr(lexical, "SEGMENT", 64)
    assert ranked(spark, docs, items, 9, max_bytes=300) == exhaustive(docs, items, 9)


def test_ties_repeats_nulls_and_common_terms(spark):
    docs = [(5, "a b"), (3, "b a"), (4, "A, b!"), (4, "A, b!"), (None, "a b"), (1, None), (2, ""), (6, "--- \n"), (7, "c é_É"), (8, "c"), (9, "c d"), (10, "c"), (11, "c")]
    items = [(1, "a"), (1, "b"), (2, "c"), (3, None), (4, ""), (5, "zzz"), (None, "É"), (6, "c d")]
    got = ranked(spark, docs, items, 4)
    assert got == exhaustive(docs, items, 4)
    assert [r[2] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])] == [3, 3, 4, 4, 4, 4, 5, 5]
    assert [r[2] for r in got if r[0] is None] == [7]  # only A-Z are lower-cased
    assert ("6", 1, 9) in [(str(r[0]), r[1], r[2]) for r in got] and not [r for r in got if r[0] in (3, 4, 5)]


def test_a_term_in_all_documents_adds_nothing(spark):
    docs = [(i, "the x" if i % 100 == 0 else "the") for i in range(700)]
    items = [(1, "the x"), (2, "the")]
    got = ranked(spark, docs, items, 3)
    assert got == exhaustive(docs, items, 3)
    assert [r[2] for r in got] == [0, 100, 200] and all(r[0] == 1 for r in got)


def test_empty_tables_and_clashing_columns(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = [(1, "one two"), (2, "alpha1 beta2 other")]
    assert rank_documents(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert rank_documents(edge_docs, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    wide = spark.createDataFrame([(*i, 1, "x", 3) for i in items], "item_id long, text string, rank int, salt string, item int")
    want = exhaustive([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()], items)
    assert sorted(map(tuple, rank_documents(edge_docs, wide).collect()), key=str) == want


def test_terms_over_chunks(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 7)
    for text in ("", "Ab cd-ef" * 9, "x" * 50, "é" * 20 + " b", "  ", "a" * 7 + " " + "b" * 8):
        assert [t.decode() for part in text_terms(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_search_stops_before_all_documents_are_looked_up():
    n = 20_000
    tf = np.concatenate([np.full(100, 50), np.full(n - 100, 1)])
    search = Search([np.array([0])], np.array([3000]), 10 * n, 10 * n * 100)
    segment = Segment(np.full(n, 100), np.arange(n + 1), np.zeros(n, np.int64), tf, search)
    docs, scores, looked = segment.best(np.array([0]), 10, 1)
    assert len(docs) == 100 and looked < 300  # ties with the tenth are all there, the others were not looked at
    _, _, with_floor = segment.best(np.array([0]), 10, int(scores.max()) + 1)
    assert with_floor <= lexical.FIRST_STEP


def test_very_long_documents_need_whole_numbers(spark):
    search = Search([np.array([0])], np.array([5]), 1 << 40, 1 << 50)
    segment = Segment(np.array([1 << 30]), np.array([0, 1]), np.array([0]), np.array([7]), search)
    m = 50 + 50 * (1 << 30) * (1 << 40) // (1 << 50)
    assert segment.impact.tolist() == [5 * (7 * 10**9 // (7000 + 20 * m))]
