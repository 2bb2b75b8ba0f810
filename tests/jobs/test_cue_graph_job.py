"""The cue graph grows with its input as the whole input would have made it."""

import datetime as dt
import random
import uuid

import pytest

from jobs.cue_graph import EDGES, grow_cue_graph, read_edges
from quadrille.operators.cue import after_edges
from quadrille.plans.views import as_facts

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def made(seed, n, start=0):
    rng = random.Random(seed)
    day = dt.datetime(2023, 12, 1)
    return [(start + i, day + dt.timedelta(days=rng.randrange(120), hours=rng.randrange(24)), rng.randrange(9), rng.choice("ab"), 0.0, '{"k": %d}' % rng.randrange(4)) for i in range(n)]


def arrive(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def edges(spark, out):
    return sorted(map(tuple, read_edges(spark, out).drop("month").collect()))


def whole(spark, path, mode="obj"):
    facts = as_facts(spark.read.schema(EVENTS).parquet(path)).where("d is not null").dropDuplicates(["line_no"])
    return sorted(map(tuple, after_edges(facts, mode).drop("write_seq").collect()))


@pytest.mark.parametrize("mode", ["obj", "subj"])
def test_two_runs_over_growing_input(spark, tmp_path, mode):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    arrive(spark, source, made(1, 60))
    first = grow_cue_graph(spark, source, out, mark, mode)
    assert (first["events"], first["batches"]) == (60, 1) and edges(spark, out) == whole(spark, source, mode)
    # New events of all months, late ones among them, and some that came before.
    arrive(spark, source, made(2, 40, start=60) + made(1, 60)[:5])
    second = grow_cue_graph(spark, source, out, mark, mode)
    assert second["events"] == 45 and edges(spark, out) == whole(spark, source, mode)
    again = grow_cue_graph(spark, source, out, mark, mode)
    assert again["batches"] == 0 and edges(spark, out) == whole(spark, source, mode)


def test_many_batches_equal_one(spark, tmp_path):
    source = f"{tmp_path}/in"
    for k in range(4):
        arrive(spark, source, made(k, 15, start=100 * k))
    assert grow_cue_graph(spark, source, f"{tmp_path}/a", f"{tmp_path}/ma", max_files=1, files=2)["batches"] == 4
    assert edges(spark, f"{tmp_path}/a") == whole(spark, source)


def test_months_before_the_new_ones_are_left_alone(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    day = dt.datetime(2024, 1, 10)
    row = lambda i, d, u: (i, d, u, "a", 0.0, '{"k": 1}')
    arrive(spark, source, [row(1, day, 1), row(2, day + dt.timedelta(days=3), 2)])
    grow_cue_graph(spark, source, out, mark)
    before = {r.f for r in read_edges(spark, out).selectExpr("_metadata.file_name AS f").collect()}
    arrive(spark, source, [row(3, day + dt.timedelta(days=90), 3)])
    grow_cue_graph(spark, source, out, mark)
    rows = read_edges(spark, out).selectExpr("src", "dst", "month", "_metadata.file_name AS f").collect()
    assert sorted((r.src, r.dst, r.month) for r in rows) == [("user_1", "user_2", "2024-01"), ("user_2", "user_3", "2024-04")]
    assert {r.f for r in rows if r.month == "2024-01"} == before


def test_a_repeated_batch_leaves_no_trace(spark, tmp_path):
    from jobs.cue_graph import grow

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    arrive(spark, source, made(3, 30))
    for _ in range(2):  # as if the stream had died before it noted the batch
        grow(spark.read.schema(EVENTS).parquet(source), 0, out, "obj", 4)
    assert edges(spark, out) == whole(spark, source) and spark.read.parquet(f"{out}/facts").count() == 30


def test_nulls_and_empty_input(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    arrive(spark, source, [])
    assert grow_cue_graph(spark, source, out, mark)["edges"] == 0
    day = dt.datetime(2024, 1, 1)
    arrive(spark, source, [(1, day, 1, "a", None, '{"k": 1}'), (2, None, 1, "a", 0.0, '{"k": 1}'), (3, day, None, "a", 0.0, '{"k": 1}'), (4, day, 2, "a", 0.0, None), (5, day, 2, "a", 0.0, '{"k": 1}')])
    done = grow_cue_graph(spark, source, out, mark)
    assert (done["events"], done["facts"], done["edges"]) == (5, 2, 1)
    assert spark.read.schema(EDGES).parquet(f"{out}/edges").first().edge_key == "a_2024-01-01T00:00:00_2024-01-01T00:00:00"


def test_settings_and_scratch_are_as_before(spark, tmp_path, monkeypatch):
    from quadrille.sources import scratch

    kept = ("spark.sql.sources.partitionOverwriteMode", "spark.sql.unionOutputPartitioning")
    before = [spark.conf.get(k, None) for k in kept]
    monkeypatch.setattr(scratch, "scratch_path", lambda _: f"{tmp_path}/scratch/{uuid.uuid4().hex}")
    arrive(spark, f"{tmp_path}/in", made(4, 20))
    assert grow_cue_graph(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")["edges"]
    assert [spark.conf.get(k, None) for k in kept] == before
    assert (tmp_path / "scratch").exists() and not list((tmp_path / "scratch").iterdir())
