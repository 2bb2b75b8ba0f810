"""The micro graph T1: orders, lookups, cue graph, the six query types."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrille.operators import cue, graph, retrieve
from quadrille.sources.files import parse_quads
from quadrille.schema import QUESTIONS

LINES = [
    "A\tvisit\tB\t2015-01-01", "C\tvisit\tB\t2015-01-03", "A\tvisit\tD\t2015-02-10", "A\tvisit\tB\t2015-03-05", "E\tvisit\tB\t2015-03-05",
    "A\taccuse\tB\t2015-03-06", "C\tvisit\tD\t2015-04-01", "A\tvisit\tB\t2015-03-05", "A\tvisit\tF", "A\tvisit\tD\t2016-01-01",
]


@pytest.fixture(scope="module")
def facts(spark):
    return parse_quads(spark.createDataFrame(list(enumerate(LINES, 1)), "line_no long, line string"))


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(x,) for x in "ABCDEF"], "name string")


def test_scan_rejects_and_shifts(spark):
    bad = ["x\ty", "A\tvisit\tB\t2015", "A\tvisit\tB\tnot-a-date", "A\tvisit\t\t2015-01-01", "\tvisit\tB\t2015-01-01", "", "a_b\tc_d\te_f\t2015-01-01T10:30"]
    rows = parse_quads(spark.createDataFrame(list(enumerate(bad, 1)), "line_no long, line string")).collect()
    assert [(r.line_no, r.s, r.r, r.o, r.d) for r in rows] == [(5, "visit", "B", "2015-01-01", None), (7, "a b", "c d", "e f", dt.date(2015, 1, 1))]
    assert rows[1].ts == dt.datetime(2015, 1, 1, 10, 30)


def _order(df, by="ord"):
    return [r.line_no for r in df.orderBy(by).collect()]


def test_ingest_and_time_order(facts):
    assert _order(graph.ingest_order(facts)) == [1, 4, 6, 8, 3, 10, 9, 2, 7, 5]
    for order, expected in (("ingest", [1, 4, 8, 2, 5]), ("time", [1, 2, 4, 5, 8])):
        assert _order(graph.ordered(facts, order).where("r = 'visit' and o = 'B'")) == expected
    assert _order(graph.ordered(facts, "ingest").where("s = 'A' and r = 'visit'")) == [1, 4, 8, 3, 10]
    assert _order(graph.ordered(facts, "time").where("s = 'A' and r = 'visit'")) == [1, 3, 4, 8, 10]


def test_edges_and_statistics(spark, facts):
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "B", "A")], "quid long, s string, o string")
    assert [r.line_no for r in graph.edges_between(pairs, facts).orderBy("pos").collect()] == [1, 4, 6, 8]
    assert graph.statistics(facts).first().asDict() == {"edges": 10, "timed_edges": 9, "subj_keys": 4, "obj_keys": 3, "nodes": 6}


def test_cue_graph_counts(facts):
    for mode, raw, kept in (("obj", 12, 11), ("subj", 10, 9)):
        after = cue.after_edges(facts, mode, "ingest")
        assert 2 * after.count() == raw
        assert cue.cue_graph(facts, mode, "ingest").count() == kept
    twin = cue.cue_graph(facts, "obj", "ingest").where("src = 'A' and dst = 'A' and time_1 = time_2").collect()
    assert [r.cue for r in twin] == ["before"]


def _ask(spark, facts, entities, order="time", compat=False, **q):
    row = {"quid": 1, "question": "", "answers": ["x"], "answer_type": "entity", "time_level": "day", "qtype": "", "time": [], "subject": "None", "object": "None", "relation": "visit", "reference_target": "None"} | q
    questions = spark.createDataFrame([tuple(row.get(f.name) for f in QUESTIONS)], QUESTIONS)
    candidates = spark.createDataFrame([(1, 1, row["relation"])], "quid long, cand_rank int, rel string")
    got = retrieve.retrieve(questions, candidates, facts, entities, order, compat=compat).join(facts.select("s", "r", "o", F.col("d").alias("fd"), "line_no"), ["s", "r", "o"]).where("d <=> fd")
    rows = got.collect()
    return sorted({r.line_no for r in rows if r.kind == "retrieved"}), sorted({r.line_no for r in rows if r.kind == "qfact"})


CASES = [
    ({"qtype": "equal", "answer_type": "time", "subject": "A", "object": "B", "question": "when"}, [1, 4, 8], []),
    ({"qtype": "equal", "answer_type": "time", "subject": "A", "object": "F", "question": "when"}, [9], []),
    ({"qtype": "equal", "object": "B", "time": ["2015-03"], "time_level": "month"}, [4, 5, 8], []),
    ({"qtype": "equal", "subject": "A", "time": ["2015-03"], "time_level": "month"}, [4, 8], []),
    ({"qtype": "equal", "subject": "A"}, [1, 3, 4, 8, 10], []),
    ({"qtype": "equal", "object": "B"}, [], []),
    ({"qtype": "equal", "object": "B", "time": ["2015-03"], "time_level": "week"}, [], []),
    ({"qtype": "equal_multi", "object": "B", "question": "in the same month", "reference_target": "C", "time_level": "month"}, [1, 2], [2]),
    ({"qtype": "equal_multi", "object": "B", "question": "who first", "time": ["2015"], "time_level": "year"}, [1], []),
    ({"qtype": "first_last", "object": "B", "question": "who first"}, [1], []),
    ({"qtype": "first_last", "object": "B", "question": "who last"}, [4, 5, 8], []),
    ({"qtype": "first_last", "answer_type": "time", "subject": "A", "object": "B", "question": "when last"}, [4, 8], []),
    ({"qtype": "before_after", "object": "B", "question": "who after", "time": ["2015-01-02"]}, [2, 4, 5, 8], []),
    ({"qtype": "before_after", "object": "B", "question": "who before", "reference_target": "E"}, [1, 2], [4, 5, 8]),
    ({"qtype": "before_last", "subject": "A", "question": "last before", "time": ["2016"], "time_level": "year"}, [4, 8], []),
    ({"qtype": "after_first", "object": "B", "question": "first after", "reference_target": "C"}, [4, 5, 8], [2]),
    ({"qtype": "before_last", "object": "B", "question": "last before", "time": ["2015-03-05"]}, [2], []),
    ({"qtype": "first_last", "object": "D", "relation": "accuse", "question": "first"}, [], []),
    ({"qtype": "unknown", "object": "B"}, [], []),
    ({"qtype": "first_last", "object": "Z", "question": "first"}, [], []),
]


def _all_cases(spark):
    base = {"question": "", "answers": [], "answer_type": "entity", "time_level": "day", "time": [], "subject": "None", "object": "None", "relation": "visit", "reference_target": "None"}
    rows = [tuple((base | {"quid": i} | q).get(f.name) for f in QUESTIONS) for i, (q, _, _) in enumerate(CASES)]
    questions = spark.createDataFrame(rows, QUESTIONS)
    return questions, questions.select("quid", F.lit(1).alias("cand_rank"), F.col("relation").alias("rel"))


def test_query_types(spark, facts, entities):
    questions, candidates = _all_cases(spark)
    got = retrieve.retrieve(questions, candidates, facts, entities).join(facts.select("s", "r", "o", F.col("d").alias("fd"), "line_no"), ["s", "r", "o"]).where("d <=> fd").collect()
    for i, (q, found, anchor) in enumerate(CASES):
        anchor = [5] if anchor == [4, 5, 8] else anchor  # the anchor is E's own fact; others of its day are not
        mine = [r for r in got if r.quid == i]
        assert sorted({r.line_no for r in mine if r.kind == "retrieved"}) == found, q
        assert sorted({r.line_no for r in mine if r.kind == "qfact"}) == anchor, q


def test_compat_orders(spark, facts, entities):
    q = {"qtype": "before_last", "subject": "A", "question": "last before", "time": ["2016"], "time_level": "year"}
    assert _ask(spark, facts, entities, "ingest", **q)[0] == [3]
    assert _ask(spark, facts, entities, compat=True, qtype="equal", subject="A", time=["2015-03"], time_level="month")[0] == []


def test_last_one_by_both_orders(spark, facts, entities):
    q = {"qtype": "equal_multi", "object": "B", "question": "who last", "time": ["2015"], "time_level": "year"}
    # One fact: line 8, whose equal twin is line 4, by time; line 5 as they were read.
    assert _ask(spark, facts, entities, **q)[0] == [4, 8]
    assert _ask(spark, facts, entities, "ingest", **q)[0] == [5]


def test_ingest_order_matches_list_model(spark):
    """Against an insertion-ordered dictionary of dictionaries."""
    import random

    rng = random.Random(5)
    for _ in range(3):
        edges = [(i, rng.choice("abcd"), "r", rng.choice("abcd"), dt.date(2020, 1, 1 + rng.randrange(9))) for i in range(1, 30)]
        nodes: dict = {}
        for n, s, _, o, _ in edges:
            nodes.setdefault(s, {})
            nodes.setdefault(o, {})
            nodes[s].setdefault(o, []).append(n)
        expected = [n for s in nodes for o in nodes[s] for n in nodes[s][o]]
        df = spark.createDataFrame(edges, "line_no long, s string, r string, o string, d date").withColumn("ts", F.col("d").cast("timestamp_ntz"))
        assert _order(graph.ingest_order(df)) == expected


def test_fused_plan_equals_separate_plans(spark, facts, entities):
    """Every type, planned together and one by one."""
    questions, candidates = _all_cases(spark)
    fused = retrieve.retrieve(questions, candidates, facts, entities)
    q = retrieve.fan_out(retrieve.valid_questions(questions, entities), candidates)
    bounded = retrieve.with_boundary(q.where("qtype in ('before_after', 'before_last', 'after_first')"), facts, entities)
    same, same_q = retrieve.equal_multi_same(q, facts)
    parts = [retrieve.equal_time(q, facts), retrieve.equal_entity(q, facts), same, same_q, retrieve.equal_multi_end(q, facts, False), retrieve.equal_multi_end(q, facts, True), retrieve.first_last_time(q, facts), retrieve.first_last_entity(q, facts), retrieve.before_after(bounded, facts), retrieve.strict_as_of(bounded, facts), retrieve._qfacts(bounded.where("a_d is not null"))]
    separate = parts[0]
    for p in parts[1:]:
        separate = separate.unionByName(p)
    assert sorted(map(str, fused.collect())) == sorted(map(str, separate.collect()))


def test_the_cue_graph_joins_no_two_large_tables(spark):
    rows = [(i, f"s{i % 3}", "r", f"o{i * 7 % 11}", f"2020-01-{1 + i // 20:02d}") for i in range(400)]
    facts = spark.createDataFrame(rows, "line_no long, s string, r string, o string, day string").select("line_no", "s", "r", "o", F.to_timestamp_ntz("day").alias("ts"), F.to_date("day").alias("d"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cue.cue_graph(facts, "subj")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    after = cue.after_edges(facts, "subj").collect()
    # Each group of about 133 facts spans ranges, of which the session has four.
    groups = {s: sorted((d, n, o) for n, x, _, o, d in rows if x == s) for s in ("s0", "s1", "s2")}
    assert sorted((r.center, r.src, r.dst, r.time_1[:10], r.time_2[:10]) for r in after) == sorted((s, a[2], b[2], a[0], b[0]) for s, g in groups.items() for a, b in zip(g, g[1:], strict=False))
    best = {}
    for r in after:
        for key, seq, x in (((r.src, r.dst, r.edge_key), (*r.write_seq.group_seq, r.write_seq.place, 0, r.center), ("after", r.fact_1, r.fact_2, r.center)), ((r.dst, r.src, f"r_{r.time_2}_{r.time_1}"), (*r.write_seq.group_seq, r.write_seq.place, 1, r.center), ("before", r.fact_2, r.fact_1, r.center))):
            best[key] = max(best.get(key, (seq, x)), (seq, x))
    assert {(r.src, r.dst, r.edge_key): (r.cue, r.fact_1, r.fact_2, r.center) for r in got.collect()} == {k: x for k, (_, x) in best.items()}
