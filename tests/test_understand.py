"""From raw question text to scores, and the parts that it takes: names, rules, model replies."""

import datetime as dt
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.config import EngineConfig
from quadrille.functions import models
from quadrille.operators import evidence, graph, ground, place, understand
from quadrille.plans import pipeline
from quadrille.sources import files

ENTITIES = ["China", "Iran", "Iraqi Interim Government", "Military (Taiwan)", "Government", "Yang Jiechi", "May"]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(x,) for x in ENTITIES], "name string")


QUESTIONS = [
    (1, "When did China negotiate with the Iraqi Interim Government?", ("China", "negotiate", "Iraqi Interim Government", "None", "None"), []),
    (2, "Before the Military (Taiwan), which country did China threaten last?", ("China", "threaten", "None", "before", "Military (Taiwan)"), []),
    (3, "Who visited Iran in May 2015?", ("None", "visited", "Iran", "None", "None"), ["2015-05"]),
    (4, "Who was criticised by Iran after 2014?", ("Iran", "criticised", "None", "after", "2014"), ["2014"]),
    (5, "who", ("None", "None", "None", "None", "None"), []),
    (6, None, ("None", "None", "None", "None", "None"), []),
    (7, "Who did Yang Jiechi first praise?", ("Yang Jiechi", "praise", "None", "first", "None"), []),
]


def test_rules(spark, entities):
    q = spark.createDataFrame([(i, t) for i, t, _, _ in QUESTIONS], "quid long, question string")
    got = {r.quid: r for r in understand.understand(q, entities)["understood"].collect()}
    for i, _, fields, time in QUESTIONS:
        assert tuple(got[i][f] for f in ground.RELATION_FIELDS) == fields, (i, got[i])
        assert got[i].time == time
    assert got[1].entities == ["China", "Iraqi Interim Government"] and got[5].entities == []
    assert understand.understand(q, entities.limit(0))["understood"].where("size(entities) > 0").count() == 0
    assert understand.understand(q.limit(0), entities)["understood"].collect() == []


def test_model_names_are_matched_compared_and_arbitrated(spark, entities):
    def make():
        """Misspells one name, forgets one, adds a date, and fails on some prompts."""

        def call(prompt):
            if prompt.startswith("List the people"):
                return "```json\n" + json.dumps(["Chinaa", "May 2015"] if "negotiate" in prompt else ["Irann"] if "Iran" in prompt else []) + "\n```"
            if prompt.startswith("Two lists"):
                return json.dumps(["China", "Iraqi Interim Government"]) if "negotiate" in prompt else "no idea"
            if prompt.startswith("Give who acts"):
                return json.dumps({"subject": "China", "relation": "negotiate"}) if "negotiate" in prompt else "sorry"
            raise RuntimeError

        return call

    q = spark.createDataFrame([(i, t) for i, t, _, _ in QUESTIONS], "quid long, question string")
    tables = understand.understand(q, entities, make=make, base=0.0)
    got = {r.quid: r for r in tables["understood"].collect()}
    assert got[1].entities == ["China", "Iraqi Interim Government"] and (got[1].subject, got[1].relation, got[1].object) == ("China", "negotiate", "None")
    assert got[3].entities == ["Iran"] and got[3].relation == "None"
    assert {r.quid for r in tables["arbitration_errors"].collect()} == {2, 7}
    assert got[2].entities == []


def test_fuzzy_names_like_all_pairs(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 12))) for _ in range(70)] + ["", "abc"]
    asked = [*known[:5], *["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 12))) for _ in range(40)], "xyz", "abcd"]
    names, dictionary = (spark.createDataFrame([(x,) for x in [*xs, None]], "name string") for xs in (asked, known))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    want = {a: min((distance(a, k), k) for k in known) for a in asked}
    for block in (4096, 16):
        got = {r.name: (r.distance, r.entity) for r in ground.nearest_by_levenshtein(names, dictionary, block).collect()}
        assert got == want
    listed = sorted(set(known))
    close = {a: next(iter(difflib.get_close_matches(a, listed, n=1, cutoff=0.6)), None) if a else None for a in asked}
    for rows in ({}, {"name_rows": 10, "entity_rows": 9}):
        assert {r.name: r.entity for r in ground.close_matches(names, dictionary, **rows).collect()} == close


def test_places_and_indexes_of_a_hub(spark):
    rows = [(i, "hub" if i % 3 else f"s{i}", "r", f"o{i % 7}", dt.datetime(2015, 1, 1 + i % 20)) for i in range(500)]
    facts = spark.createDataFrame(rows, "line_no long, s string, r string, o string, ts timestamp_ntz").withColumn("d", F.col("ts").cast("date"))
    got = place.placed(facts, ["s", "r"], ["ts", "line_no"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (r.s, r.place)):
        groups.setdefault(r.s, []).append((r.ts, r.line_no, r.place))
    assert all([p for _, _, p in g] == list(range(1, len(g) + 1)) and g == sorted(g) for g in groups.values())
    parts = graph.subject_index(facts).where("s = 'hub'").collect()
    assert len(parts) == 1 and parts[0].size == 333
    small = graph.index(facts, ("s", "r"), rows=50).where("s = 'hub'").orderBy("part").collect()
    assert [r.size for r in small] == [50] * 6 + [33] and [f.line_no for r in small for f in r.facts] == [f.line_no for f in parts[0].facts]


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    for name, begin, n in (("a", 0, 400), ("b", 400, 1), ("c", 401, 900)):
        (tmp_path / f"{name}.txt").write_text("".join(f"line{i}\n" for i in range(begin, begin + n)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.line_no, r.line) for r in rows) == [(i + 1, f"line{i}") for i in range(1301)]


def test_json_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", ["a"], None), (2, None, [], 1.5)], "quid long, x string, l array<string>, y double")
    path = f"{tmp_path}/out.json"
    assert files.write_json_array(df, path, 2) == 2
    assert json.load(open(path, encoding="utf-8")) == [{"quid": 1, "x": "é", "l": ["a"], "y": None}, {"quid": 2, "x": None, "l": [], "y": 1.5}]
    assert files.write_json_array(df.limit(0), path) == 0 and json.load(open(path)) == []
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"quid": 1, "question": "a"}\n{"quid": 2}\n')
    assert [(r.quid, r.question) for r in files.read_questions(spark, str(lines)).orderBy("quid").collect()] == [(1, "a"), (2, None)]


def test_batched_generation_and_rates(spark, tmp_path):
    def load():
        def model(prompts):
            assert len(prompts) <= 3
            if "bad" in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

        return model

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bad", "c", None, "d", "e"])], "quid long, prompt string").coalesce(1)
    replies = models.generate(df, models.local_generator(load, 3), base=0.0)
    assert {r.quid: r.raw for r in replies.collect()} == {0: "A", 1: "B", 2: "", 3: "C", 4: "", 5: "D", 6: "E"}
    rates = models.with_rates(replies, lambda x: x.write.parquet(f"{tmp_path}/r"))
    assert (rates["total"], rates["answered"], rates["failed"]) == (7, 5, 2) and rates["per_second"] > 0


def test_traces_decide_the_ratio_gate(spark):
    day = dt.date(2015, 1, 3)
    facts = spark.createDataFrame([(q, i, f"S{i}", "r", "o", day + dt.timedelta(days=i)) for q in (1, 2) for i in range(6)], "quid long, pos int, s string, r string, o string, d date")
    cues = spark.createDataFrame([(q, "same", day, None) for q in (1, 2)], "quid long, cue string, anchor date, target string")
    questions = spark.createDataFrame([(1, "agree"), (2, "differ")], "quid long, question string")

    def make():
        def call(prompt):
            listed = json.loads(prompt.rsplit("Facts: ", 1)[1])
            kept = listed[:1] if "agree" in prompt else listed
            return json.dumps({"trace": [{"event": x, "ts": x[-10:]} for x in kept]})

        return call

    final, stats = evidence.select_evidence(facts, cues, verdicts=evidence.trace_verifier(questions, make, base=0.0))
    assert {r.quid: (r.verifier_triggered, r.verifier_accepted) for r in stats.collect()} == {1: (True, True), 2: (True, False)}
    assert {r.quid: r.n for r in final.groupBy("quid").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 6}


def test_raw_questions_to_hits(spark, tmp_path):
    """Only text, type and gold answers are given; Hit@1 comes out."""
    rows = [f"P{i % 5}\t{r}\tQ{i % 7}\t2015-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(120) for r in ("Make_a_visit", "Accuse")]
    (tmp_path / "full.txt").write_text("\n".join(rows))
    names = spark.createDataFrame([(f"{k}{i}", i) for k, n in (("P", 5), ("Q", 7)) for i in range(n)], "name string, id int")
    relations = spark.createDataFrame([("Make a visit", 0), ("Accuse", 1)], "name string, id int")
    asked = [
        {"quid": 1, "question": "Who did P1 first accuse?", "answers": ["Q1"], "answer_type": "entity", "qtype": "first_last", "time_level": "day"},
        {"quid": 2, "question": "Who accused Q3 in 2015-04?", "answers": ["P2", "P3"], "answer_type": "entity", "qtype": "equal", "time_level": "month"},
        {"quid": 3, "question": "Who accused nobody?", "answers": ["x"], "answer_type": "entity", "qtype": "equal", "time_level": "day"},
    ]
    (tmp_path / "test.jsonl").write_text("\n".join(json.dumps(x) for x in asked))
    out = f"{tmp_path}/out"
    inputs = pipeline.Inputs(files.read_quads(spark, f"{tmp_path}/full.txt"), files.read_questions(spark, f"{tmp_path}/test.jsonl"), names, relations)
    config = EngineConfig(relation_top_k=1)
    tables = pipeline.run(inputs, config, out=out, understand_questions=True)
    hits = {(r.dimension, r.value): (r.hit, r.total) for r in tables["scores"].collect()}
    assert hits["overall", "all"] == (2, 3)
    assert [r.quid for r in tables["empty"].collect()] == [3]
    again = pipeline.run(inputs, config, start_step=3, out=out, understand_questions=True)
    assert sorted(map(str, again["predictions"].collect())) == sorted(map(str, tables["predictions"].collect()))
    assert pipeline.export(again, f"{tmp_path}/json")["predictions"] == 3


def test_versions_of_a_table(spark, tmp_path):
    """The newest complete version is read; one that a run left half written is not, and goes with the older ones."""
    path = f"{tmp_path}/t"
    assert files.current_version(spark, path) == path
    for n in range(3):
        files.write_results(spark.range(n + 1), files.new_version(spark, path))
        assert files.current_version(spark, path) == f"{path}/v{n + 1}"
    assert files.new_version(spark, path) == f"{path}/v4" and sorted(x.name for x in (tmp_path / "t").iterdir()) == ["v3"]
    (tmp_path / "t" / "v4").mkdir()
    assert files.current_version(spark, path) == f"{path}/v3" and files.new_version(spark, path) == f"{path}/v5"
    assert spark.read.parquet(files.current_version(spark, path)).count() == 3
