"""The evidence micro fixtures over pool P, text functions, and answering."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrille.functions import models
from quadrille.functions import temporal as T
from quadrille.functions import text as X
from quadrille.operators import answer, evaluate, evidence, ground, vector
from quadrille.sources import files

D = dt.date
P = [(1, "A", D(2015, 1, 1)), (2, "C", D(2015, 1, 3)), (3, "A", D(2015, 3, 5)), (4, "E", D(2015, 3, 5)), (5, "A", D(2015, 3, 5))]


@pytest.fixture(scope="module")
def pool(spark):
    cues = [("after", D(2015, 1, 3)), ("before", D(2015, 3, 5)), ("last", None), ("same", D(2015, 3, 5)), (None, None), ("after", D(2016, 1, 1)), ("same", D(2015, 1, 3))]
    facts = [(q, pos, s, "visit", "B", d) for q in range(len(cues)) for pos, s, d in P]
    return (
        spark.createDataFrame(facts, "quid long, pos int, s string, r string, o string, d date"),
        spark.createDataFrame([(q, c, a, None) for q, (c, a) in enumerate(cues)], "quid long, cue string, anchor date, target string"),
    )


def _by_quid(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.quid, set()).add((r.s, r.d.isoformat()[5:]))
    return out


def test_trigger(pool):
    rows = evidence.trigger_score(pool[0]).collect()
    assert {(r.n, r.signatures, round(r.score, 5)) for r in rows} == {(5, 3, 0.28333)}
    assert not any(r.triggered for r in evidence.trigger_gate(pool[0]).collect())
    assert evidence.triggered_only(pool[0]).count() == 0


def test_gate_is_strict(spark):
    facts = [(q, i, str(i), "r", "o", D(2015, 1, 1)) for q, n in ((1, 45), (2, 46)) for i in range(n)]
    got = evidence.trigger_gate(spark.createDataFrame(facts, "quid long, pos int, s string, r string, o string, d date")).collect()
    assert {r.quid: r.triggered for r in got} == {1: False, 2: True}


def test_prededup(pool):
    got = _by_quid(evidence.prededup(*pool))
    assert got[0] == {("A", "03-05"), ("E", "03-05")}
    assert got[1] == {("A", "01-01"), ("C", "01-03")}
    assert got[2] == {("A", "03-05"), ("C", "01-03"), ("E", "03-05")}
    assert got[3] == {("A", "03-05"), ("E", "03-05")}
    assert 5 not in got
    every = _by_quid(evidence.prededup_or_all(*pool))
    assert every[5] == {(s, d.isoformat()[5:]) for _, s, d in P}


def test_stages_and_statistics(pool):
    facts, cues = pool
    reps = evidence.stage1(facts, cues)
    assert _by_quid(reps)[4] == {("A", "01-01"), ("C", "01-03"), ("A", "03-05"), ("E", "03-05")}
    chosen = _by_quid(evidence.stage2(reps, cues.select("quid", "target")))
    assert 5 not in chosen and chosen[6] == {("C", "01-03")}
    broken = evidence.stage2(reps, cues.select("quid", F.lit("accuse").alias("target")))
    assert _by_quid(broken)[0] == _by_quid(reps)[0]
    final, stats = evidence.select_evidence(facts, cues)
    row = {r.quid: r for r in stats.collect()}
    assert (row[6].n_dedup, row[6].n_select, row[6].ratio, row[6].verifier_triggered, row[6].verifier_accepted) == (4, 1, 4.0, True, False)
    assert (row[5].n_select, row[5].ratio, row[5].verifier_accepted) == (0, None, None)
    assert len(_by_quid(final)[6]) == 4
    accepted, _ = evidence.select_evidence(facts, cues, verdicts=cues.select("quid", F.lit(True).alias("accepted")))
    assert len(_by_quid(accepted)[6]) == 1


def test_untriggered_sets_pass_unchanged(pool):
    final, counts = evidence.filter_evidence(*pool)
    assert final.count() == pool[0].count()
    assert not any(r.filtered or r.triggered for r in counts.collect())


def _values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalar_functions(spark):
    asked = ["Before 14 October 2015, who", "in October 2015", "in 2012", "on 2020-05-15", "25-12-2015", "05-12-2015", "Oct 5, 2015", "May 12", None, ""]
    assert _values(spark, T.time_expression, asked) == ["2015-10-14", "2015-10", "2012", "2020-05-15", "2015-12-25", "2015-05-12", "2015-10-05", None, None, None]
    assert _values(spark, T.parse_iso, ["2015", "2015-04", "2015-02-30", "215", None]) == [D(2015, 1, 1), D(2015, 4, 1), None, None, None]
    assert _values(spark, T.parse_text_date, ["31 February 2015", "in 2012", "since 2012"]) == [D(2015, 2, 1), D(2012, 1, 1), None]
    assert _values(spark, X.cue_of_phrase, ["last before", "in the same month as", "in 2012", "None", None]) == ["before", "same", "same", None, None]
    assert _values(spark, X.normalise_answer, ["The Citizen (Spain)!", "", None]) == ["citizen spain", "", None]
    assert _values(spark, T.is_date_entity, ["City Mayor", "25 April 2005", "April Institute", "May", "", None]) == [False, True, False, True, False, False]
    assert _values(spark, lambda x: T.is_date_entity(x, compat=True), ["City Mayor"]) == [True]


def test_kappa_floors(spark):
    df = spark.createDataFrame([(D(2015, 1, 1),), (D(2014, 12, 31),)], "d date")
    got = df.select(T.kappa(F.col("d"), F.lit("before"), F.lit("2015-01-03").cast("date"), F.lit(None), 2).alias("k")).collect()
    assert [r.k for r in got] == [-1, -2]


def test_sentences_to_facts(spark):
    rows = [(1, 1, "China Accuse Iran in 2015-01-02", ["China", "Iran"]), (2, 1, "A B in 2015-01-02", []), (3, 1, "no date here", ["no"]), (4, 1, "X sees the big Moon in 2015-01-02", ["X", None])]
    df = spark.createDataFrame(rows, "quid long, pos int, fact string, entities array<string>")
    known = spark.createDataFrame([("moon",), ("big moon",)], "name string")
    got = {r.quid: (r.s, r.r, r.o) for r in evidence.facts_of_sentences(df, known).collect()}
    assert got == {1: ("China", "Accuse", "Iran"), 4: ("X", "sees the", "big Moon")}


def test_cascade_order(spark):
    g = spark.createDataFrame([(1, 1, "r", "qfact", 1, "a", "r", "b", D(2020, 1, 1)), (2, 1, "r", "retrieved", 1, "c", "r", "d", D(2020, 1, 1)), (2, 1, "r", "qfact", 1, "a", "r", "b", D(2020, 1, 1))], "quid long, cand_rank int, rel string, kind string, pos int, s string, r string, o string, d date")
    s = spark.createDataFrame([(1, 1, "f"), (3, 1, "f"), (4, 1, "f")], "quid long, rank int, fact string")
    c = spark.createDataFrame([(3, 1, "k", False)], "quid long, pos int, fact string, triggered boolean")
    got = [(r.quid, r.fact, r.source) for r in answer.cascade(g, s, c).orderBy("quid", "pos").collect()]
    assert got == [(1, "f", "semantic"), (2, "a r b in 2020-01-01", "graph"), (2, "c r d in 2020-01-01", "graph"), (3, "k", "causal"), (4, "f", "semantic")]
    assert [r.source for r in answer.cascade(g, s, c, "triggered_only").where("quid = 3").collect()] == ["semantic"]


def test_hits(spark):
    rows = [(["2012-05-01"], ["2012-05"]), (["Portugal", "Spain"], ["Spain"]), ([], ["x"]), (["y"], [""]), (None, ["x"])]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    got = df.select(*[evaluate.hit_at(F.col("p"), F.col("g"), k).alias(f"k{k}") for k in (1, 2)]).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 1), (0, 0), (1, 1), (0, 0)]


def test_self_comparison_has_no_conflicts(spark):
    df = spark.createDataFrame([(1, ["A", " b"]), (2, None)], "quid long, entities array<string>")
    assert ground.entity_conflicts(df, df).count() == 0


def test_generator_retries_and_keeps_order(spark):
    def make():
        calls = {}

        def call(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "twice" and calls[prompt] < 2):
                raise RuntimeError
            return prompt.upper()

        return call

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "twice"), (4, None)], "quid long, prompt string")
    got = models.generate(df, make, concurrency=2, base=0.0)
    assert {r.quid: r.raw for r in got.collect()} == {1: "A", 2: "", 3: "TWICE", 4: ""}


def test_resumable_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "quid long, x string")
    path = str(tmp_path / "out")
    assert files.append_results(df.where("quid = 1"), path) == 1
    assert files.append_results(df, path) == 1
    assert sorted(r.quid for r in spark.read.parquet(path).collect()) == [1, 2]


def test_exact_and_cell_search(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "fact_id long, vector array<float>")
    q = df.where("fact_id < 5").select(F.col("fact_id").alias("quid"), "vector")
    exact = {(r.quid, r.rank): r.fact_id for r in vector.top_k(q, df, 3, query_rows=2, corpus_rows=50).collect()}
    y = x.astype(np.float32).astype(float)
    for i in range(5):
        assert [exact[i, k] for k in (1, 2, 3)] == np.argsort(-(y @ y[i]))[:3].tolist()
    near = {(r.quid, r.rank): r.fact_id for r in vector.top_k_cells(q, df, 3, cells=8, probes=8).collect()}
    assert near == exact


def test_cell_search_is_exact_with_few_probes(spark):
    """One probe of 16 cells: what the probed cell lacks comes from the cells whose bound is not under the k-th score."""
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "fact_id long, vector array<float>")
    q = df.where("fact_id < 20").select(F.col("fact_id").alias("quid"), "vector")
    exact = {(r.quid, r.rank): r.fact_id for r in vector.top_k(q, df, 10).collect()}
    for blocks in ({}, {"corpus_rows": 7, "query_rows": 7}):
        near = {(r.quid, r.rank): r.fact_id for r in vector.top_k_cells(q, df, 10, cells=16, probes=1, **blocks).collect()}
        assert near == exact
    few = df.where("fact_id < 30")
    got = {(r.quid, r.rank): r.fact_id for r in vector.top_k_cells(q, few, 40, cells=16, probes=1).collect()}
    assert got == {(r.quid, r.rank): r.fact_id for r in vector.top_k(q, few, 40).collect()} and len(got) == 20 * 30


def test_semantic_query_searches_all_facts(spark, tmp_path):
    import numpy as np

    from quadrille.plans import views
    from quadrille.plans.text_queries import QUERIES

    rows = [(i, dt.datetime(2024, 1, 1 + i % 30), i % 9, ("view", "buy", "click")[i % 3], '{"k": %d}' % (i % 8)) for i in range(1, 90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    encode = vector.hashing_encoder()
    facts = {r.line_no: r.fact for r in files.fact_sentences(views.facts_ev(spark, str(tmp_path))).collect()}
    asked = {r.quid: r.question for r in views.questions(spark, str(tmp_path)).collect()}
    score = encode(list(asked.values())).astype(float) @ encode(list(facts.values())).astype(float).T
    ids = np.array(list(facts))
    want = {q: ids[np.lexsort((ids, -s))[:20]].tolist() for q, s in zip(asked, score, strict=True)}
    got = {}
    for r in QUERIES["semantic_search"](spark, str(tmp_path)).orderBy("quid", "rank").collect():
        got.setdefault(r.quid, []).append(r.fact_id)
        assert r.fact == facts[r.fact_id]
    assert len(got) == 2 and got == want


def test_long_names_and_names_with_signs(spark):
    long = "Ministry of " + " and ".join(f"Part {i}" for i in range(8))
    names = spark.createDataFrame([(long,), ("A.B. Bardhan",), ("ATCO Ltd.",), ("Ltd",), ("?!",), ("Iran",), (None,)], "name string")
    asked = [f"Who met the {long}?", 'Did "A.B. Bardhan" visit Iran?', "when did ATCO Ltd. sell?", "who", "?", None, "Iran"]
    q = spark.createDataFrame(list(enumerate(asked)), "quid long, question string")
    assert {r.quid: r.entity for r in ground.dictionary_entities(q, names).collect()} == {0: long, 1: "A.B. Bardhan", 2: "ATCO Ltd.", 6: "Iran"}
    assert {r.quid for r in ground.dictionary_entities(q, names, longest=12).collect()} == {1, 2, 6}
    assert ground.dictionary_entities(q, names.limit(0)).collect() == []


def test_a_task_sorts_a_bounded_part_of_the_pools(spark, monkeypatch):
    from quadrille.operators import place
    from quadrille.plans import views

    monkeypatch.setattr(place, "TASK_ROWS", 100)
    pools = views.pools(spark, "/root/testdata/sf0.001")
    assert pools.rdd.getNumPartitions() >= pools.count() // 100 > 4


def test_the_dictionary_is_met_once_and_hits_are_numbers(spark):
    q = spark.createDataFrame([(1, "was Rome or Bonn, or New York older than Rome?"), (2, "nothing"), (3, "rome, BONN")], "quid long, question string")
    names = spark.createDataFrame([("Rome",), ("Bonn",), ("New York",), ("Rome",)], "name string")
    got = ground.dictionary_entities(q, names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and sorted(map(tuple, got.collect())) == [(1, "New York"), (3, "Bonn")]


def test_facts_are_read_once_by_the_filter(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(row):
        seen.add(1)
        return row

    rows = [(q, i, "s", f"r{i % 3}", f"o{i % 2}", f"2020-01-{1 + i % 28:02d}") for q, n in ((1, 60), (2, 3), (3, 50)) for i in range(n)]
    made = spark.sparkContext.parallelize(rows, 4).map(read)
    facts = spark.createDataFrame(made, "quid long, pos int, s string, r string, o string, day string").select("quid", "pos", "s", "r", "o", F.to_date("day").alias("d"))
    cues = spark.createDataFrame([(1, "after", "2020-01-10"), (2, None, None), (3, "same", "1999-01-01")], "quid long, cue string, day string").select("quid", "cue", F.to_date("day").alias("anchor"))
    _, counts = evidence.filter_evidence(facts, cues)
    assert {r.quid: (r.original_fact_num, r.triggered) for r in counts.collect()} == {1: (60, True), 2: (3, False), 3: (50, True)}
    assert seen.value == len(rows)
