"""Packing of prompts by tokens and the rate of a whole job."""

import random

import pytest

from quadrille.functions import models


def test_packs_hold_the_budget():
    rng = random.Random(1)
    rows = [(i, "x", n) for i, n in enumerate(sorted(rng.randrange(1, 500) for _ in range(2000)))] + [(3000, "y", 9999)]
    got = list(models.packs(iter(rows), 4096))
    assert [r for p in got for r in p] == rows
    assert all(len(p) * max(r[2] for r in p) <= 4096 for p in got[:-1]) and got[-1] == [(3000, "y", 9999)]
    padded = sum(len(p) * max(r[2] for r in p) for p in got)
    assert 1 - sum(r[2] for r in rows) / padded < 0.05
    assert list(models.packs(iter([]), 10)) == []


@pytest.mark.parametrize("per_second", [None, 1000.0])
def test_prompts_are_packed_over_all_partitions(spark, tmp_path, per_second):
    rng = random.Random(2)
    rows = [(i, "p" * rng.randrange(1, 1200)) for i in range(1500)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "quid long, prompt string").repartition(7)
    seen = str(tmp_path / "lists")

    def load():
        def call(prompts):
            with open(seen, "a") as f:
                f.write(",".join(str(1 + len(p) // 4) for p in prompts) + "\n")
            return [f"{len(p)}" for p in prompts]

        return call

    got = {r.quid: r.raw for r in models.generate(df, models.local_generator(load), base=0.0, budget=8192, per_second=per_second, workers=3).collect()}
    assert got == {i: str(len(p)) if p else "" for i, p in rows}
    lists = [[int(x) for x in line.split(",")] for line in open(seen).read().split()]
    padded = sum(len(x) * max(x) for x in lists)
    assert max(len(x) * max(x) for x in lists) <= 8192 and 1 - sum(map(sum, lists)) / padded < 0.1


def test_pace_spreads_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = models.Pace(4, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        pace.wait()
    assert now[0] == pytest.approx(1.0) and len(slept) == 4


def test_rates_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "quid long, prompt string").distinct()
    rates = models.with_rates(models.generate(none, models.listing_generator()), lambda x: x.write.parquet(f"{tmp_path}/r"))
    assert (rates["total"], rates["failed"]) == (0, 0)
