"""Rows of retrieval that are numbered by question before they are made."""

import datetime

from pyspark.sql import functions as F
from quadrille.operators import answer, evidence, retrieve
from quadrille.plans import views as V
from quadrille.plans.evidence_queries import QUERIES

SF = "/root/testdata/sf0.001"


def tables(spark):
    return V.questions(spark, SF), V.candidates(spark, SF), V.facts_ev(spark, SF), V.entities(spark, SF)


def rows(df):
    return sorted(map(str, df.collect()))


def windows_over_facts(df):
    """Windows of the plan whose rows hold the text or the ends of facts."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]


def test_counted_rows_are_those_of_retrieve(spark):
    counted, found = retrieve.retrieve_counted(*tables(spark))
    plain = retrieve.retrieve(*tables(spark))
    assert rows(counted.drop(*retrieve.COUNTED)) == rows(plain) and plain.count()
    assert rows(evidence.collect_graph_facts(counted)) == rows(evidence.collect_graph_facts(plain))
    assert rows(found) == rows(plain.where("kind = 'retrieved'").select("quid").distinct())
    assert rows(counted.groupBy("quid").agg(F.max("whole").alias("n"))) == rows(plain.groupBy("quid").agg(F.count(F.when(F.col("kind") == "retrieved", 1)).alias("n")))


def test_facts_of_questions_are_numbered_without_a_window_over_them(spark):
    assert not windows_over_facts(QUERIES["collect_graph_facts"](spark, SF))


def test_cascade_of_counted_rows_equals_the_plain_one(spark):
    questions = V.questions(spark, SF)
    semantic = questions.where("quid % 2 = 0").select("quid", F.explode(F.array(F.lit(5), F.lit(3))).alias("rank"), F.concat(F.lit("s"), "quid").alias("fact"))
    causal = questions.where("quid % 5 = 0").select("quid", F.explode(F.array(F.lit(4), F.lit(9))).alias("pos"), F.concat(F.lit("c"), "quid").alias("fact"), (F.col("quid") % 2 == 0).alias("triggered"))
    counted, found = retrieve.retrieve_counted(*tables(spark))
    for override in ("always", "triggered_only"):
        plain = answer.cascade(counted.drop(*retrieve.COUNTED), semantic, causal, override)
        assert rows(answer.cascade(counted, semantic, causal, override, found)) == rows(plain) and plain.count()


def test_first_answers_are_one_row_a_question(spark):
    day = datetime.date(2024, 1, 2)
    questions = spark.createDataFrame(
        [(1, "q", ["b"], "entity", "day", "equal", "Single", "a", "None"), (2, "q", ["x"], "time", "month", "equal", "Single", "a", "None"), (3, "q", ["x"], None, None, "equal", "Single", "None", "o")],
        "quid long, question string, answers array<string>, answer_type string, time_level string, qtype string, qlabel string, subject string, object string",
    )
    facts = spark.createDataFrame([(q, "a", "r", f"o{i}", day) for q in (1, 2, 3) for i in range(5, 0, -1)], "quid long, s string, r string, o string, d date")
    every = {r.quid: r.model_answer for r in answer.predictions(questions, facts).collect()}
    first = {r.quid: r.model_answer for r in answer.predictions(questions, facts, first=True).collect()}
    assert every == {1: [f"o{i}" for i in range(1, 6)], 2: ["2024-01"], 3: ["a"]} and first == {q: a[:1] for q, a in every.items()}
    lone = answer.predictions(questions, facts.where("quid = 2"), first=True)
    assert {r.quid: r.model_answer for r in lone.collect()} == {1: [], 2: ["2024-01"], 3: []}
    plan = answer.predictions(questions, facts, first=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "row_number" not in plan
