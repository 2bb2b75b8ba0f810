"""The kept vector index and the store of text vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import vector
from quadrille.operators.vector_index import VectorIndex, kept_vectors

SCHEMA = "fact_id long, vector array<float>"


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(f) for f in v]) for i, v in enumerate(x)], SCHEMA)


def queries(spark, x):
    return frame(spark, x).withColumnRenamed("fact_id", "quid")


def best(q, x, k):
    score = q.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    return {(i, r): int(j) for i, row in enumerate(score) for r, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:k], 1)}


def got(hits):
    return {(r.quid, r.rank): r.fact_id for r in hits.collect()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) + 4 * rng.normal(size=(9, 12))[rng.integers(0, 9, 900)]
    return x, x[rng.permutation(900)[:40]] + 0.1 * rng.normal(size=(40, 12))


def test_exact_with_one_probe_and_small_blocks(spark, tmp_path, points):
    x, q = points
    index = VectorIndex.build(frame(spark, x), f"{tmp_path}/i", cells=16)
    for blocks in ({}, {"query_rows": 7, "corpus_rows": 20}):
        assert got(index.search(queries(spark, q), 10, probes=1, **blocks)) == best(q, x, 10)


def test_a_second_search_reads_only_the_cells_it_probes(spark, tmp_path, points):
    x, q = points
    VectorIndex.build(frame(spark, x), f"{tmp_path}/i", cells=16)
    index = VectorIndex(spark, f"{tmp_path}/i")
    near = index.search(queries(spark, q[:1]), 5, probes=1, exact=False)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    own = int(np.argmax(q[0] @ index.centre.T - 0.5 * (index.centre**2).sum(axis=1)))
    cells = {r.fact_id: r.cell for r in index.entries().select("fact_id", "cell").collect()}
    assert {cells[r.fact_id] for r in near.collect()} == {own}
    read = index.entries().where(F.col("cell").isin([own]))
    assert len(read.inputFiles()) == len(index.entries().inputFiles())  # files of the table …
    assert {r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()} == {f for f in index.entries().inputFiles() if f"/cell={own}/" in f}  # … and of the cell


def test_codes_leave_few_candidates(spark, tmp_path, points):
    x, q = points
    index = VectorIndex.build(frame(spark, x), f"{tmp_path}/i", cells=16)
    n, radius = index.sizes()
    found = index._meet(queries(spark, q).select("quid", "vector"), n, radius, 10, 16, None, 1000, 1000)
    least = index._least(found, 10)
    left = found.join(least, "quid").where("upper >= least").count()
    assert int(n.sum()) == 900 and 400 <= left <= 480  # of 36,000 pairs


def test_appends_go_to_their_cells_and_repeat_safely(spark, tmp_path, points):
    x, q = points
    index = VectorIndex.build(frame(spark, x[:300]), f"{tmp_path}/i", cells=8)
    before = set(index.entries().inputFiles())
    assert index.add(frame(spark, x[:700])) == 400 and index.add(frame(spark, x[:700])) == 0
    assert before <= set(index.entries().inputFiles())
    assert index.add(frame(spark, x)) == 200
    again = VectorIndex(spark, f"{tmp_path}/i")
    assert got(again.search(queries(spark, q), 10, probes=2)) == best(q, x, 10)
    # Vectors far from all that the centres were fitted on are found, too.
    far = np.concatenate([x, 50 + x[:5]])
    assert again.add(frame(spark, far)) == 5
    assert got(again.search(queries(spark, q), 10, probes=1)) == best(q, far, 10)


def test_ties_nulls_few_rows_and_empty(spark, tmp_path):
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 0]])
    rows = frame(spark, x).union(spark.createDataFrame([(9, None), (None, [1.0, 1.0])], SCHEMA))
    index = VectorIndex.build(rows, f"{tmp_path}/i", cells=3)
    asked = queries(spark, np.array([[1.0, 0], [0, 0]])).union(spark.createDataFrame([(7, None)], "quid long, vector array<float>"))
    assert got(index.search(asked, 6, probes=1)) == {(0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 3, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}
    empty = VectorIndex.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e", cells=3)
    assert empty.search(asked, 5).count() == 0 and empty.add(spark.createDataFrame([], SCHEMA)) == 0


def test_only_new_texts_are_encoded(spark, tmp_path):
    met = f"{tmp_path}/met"
    count = lambda: len([line for p in (tmp_path / "met").glob("*") for line in p.read_text().splitlines()]) if (tmp_path / "met").exists() else 0

    def encoder(texts):
        import os
        import uuid

        os.makedirs(met, exist_ok=True)
        with open(f"{met}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{t}\n" for t in texts)
        return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(len(texts), 2)

    encode = lambda new: vector.encode_texts(new, "text", encoder)
    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "id long, fact string")
    first, n = kept_vectors(rows("a", "bb", "a", None), "fact", f"{tmp_path}/store", "e1", encode)
    assert n == 3 and count() == 3
    assert {(r.id, tuple(r.vector)) for r in first.collect()} == {(0, (1.0, 1.0)), (1, (2.0, 1.0)), (2, (1.0, 1.0)), (3, (0.0, 1.0))}
    second, n = kept_vectors(rows("bb", "ccc", "a"), "fact", f"{tmp_path}/store", "e1", encode)
    assert n == 1 and count() == 4 and second.where("vector[0] = length(fact)").count() == 3
    assert kept_vectors(rows("a"), "fact", f"{tmp_path}/store", "e2", encode)[1] == 1  # another encoder, other vectors


def test_a_search_of_many_texts_makes_no_index(spark, monkeypatch):
    def no_index(*_, **__):
        raise AssertionError("an index for one search")

    monkeypatch.setattr(vector, "top_k_cells", no_index)
    encoder = lambda texts: np.array([[float(t), 1.0] for t in texts], np.float32)
    facts = spark.range(70_000).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("fact"))
    questions = spark.createDataFrame([(1, "1"), (2, "-1")], "quid long, question string")
    assert got(vector.semantic_search(questions, facts, 2, encoder)) == {(1, 1): 69_999, (1, 2): 69_998, (2, 1): 0, (2, 2): 1}


@pytest.mark.parametrize("least", [None, "least"])
def test_a_frame_of_queries_and_their_cells_is_bounded(least):
    from types import SimpleNamespace

    import pandas as pd

    from quadrille.operators import vector_index

    rng = np.random.default_rng(2)
    centre = rng.normal(size=(64, 4))
    shared = SimpleNamespace(value=(centre, np.ones(64, bool), np.ones(64)))
    batch = pd.DataFrame({"quid": range(1000), "vector": list(rng.normal(size=(1000, 4))), "least": np.nan})
    frames = list(vector_index._asking(shared, 60, least)(iter([batch])))
    assert max(map(len, frames)) <= 16_384
    asked = pd.concat(frames).groupby("quid").size()
    assert len(asked) == 1000 and (asked == (4 if least else 60)).all()


def test_equal_questions_and_facts_are_compared_once(spark, monkeypatch):
    compared, search = [], vector.search_vectors

    def seen(questions, known, *rest, **named):
        compared.append((questions.count(), known.count()))
        return search(questions, known, *rest, **named)

    monkeypatch.setattr(vector, "search_vectors", seen)
    texts, asked = ["a b in 2001", "a b in 2002", "c d in 2001", None], ["When a b?", None, "When c d?"]
    facts = spark.createDataFrame([(i, texts[i * 7 % 4]) for i in range(40)], "line_no long, fact string")
    questions = spark.createDataFrame([(i, asked[i % 3]) for i in range(9)], "quid long, question string")
    vectors, encode = {}, vector.hashing_encoder()
    for t in (*texts, *asked):
        vectors[t] = encode([t or ""])[0].astype(float)
    for k in (3, 15):
        want = {}
        for q in range(9):
            score = {i: round(float(vectors[asked[q % 3]] @ vectors[texts[i * 7 % 4]]), 9) for i in range(40)}
            want |= {(q, rank): (i, texts[i * 7 % 4]) for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1)}
        assert {(r.quid, r.rank): (r.fact_id, r.fact) for r in vector.semantic_search(questions, facts, k).collect()} == want
    assert set(compared) == {(3, 4)}


@pytest.mark.parametrize(("tile", "scores", "pairs"), [(64, 64, 3), (128, 1000, 50), (8192, 4_000_000, 8192)])
def test_best_pairs_equal_double_precision(monkeypatch, tile, scores, pairs):
    for name, value in (("TILE", tile), ("SCORES", scores), ("PAIRS", pairs)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(tile)
    for size in (1.0, 1e-25, 1e30):
        for y in (rng.integers(-2, 3, (300, 5)).astype(np.float32), rng.normal(size=(70, 5)), 1 + rng.normal(size=(500, 5)) * 1e-9):
            x, order = rng.integers(-2, 3, (20, 5)) * size * 10.0 ** rng.integers(-30, 5, (20, 1)), rng.permutation(len(y))
            score = np.einsum("id,jd->ij", x, y.astype(float))
            want = [(i, j, score[i, j]) for i in range(20) for j in np.lexsort((order, -score[i]))[:7]]
            assert list(zip(*vector.best_pairs(x, y, order, 7), strict=True)) == want
