"""As-of retrieval by places against a plain reading of each pool."""

import datetime as dt
import random

from quadrille.operators import retrieve
from quadrille.operators.asof import pool_rows

ASKS = "quid long, rel string, s string, o string, time_level string, at date, side int, takes string, take_last boolean"
DAY = dt.date(2023, 11, 20)


def period(d, level):
    return {"year": (d.year,), "month": (d.year, d.month), "day": (d.year, d.month, d.day)}.get(level)


def plain(ask, facts, limit):
    """line_no of what a question takes."""
    quid, rel, s, o, level, at, side, takes, last = ask
    if (s is None) == (o is None):
        return []
    pool = sorted((t, n) for n, a, r, b, t in facts if t is not None and r == rel and (a == s if s is not None else b == o))
    if side is not None:
        if at is None or period(at, level) is None:
            return []
        sign = lambda t: (period(t.date(), level) > period(at, level)) - (period(t.date(), level) < period(at, level))
        pool = [x for x in pool if sign(x[0]) == side]
    if not pool:
        return []
    if takes == "day":
        end = (pool[-1] if (side == -1 or (side in (None, 0) and last)) else pool[0])[0].date()
        pool = [x for x in pool if x[0].date() == end]
    elif takes == "one":
        pool = pool[-1:] if last else pool[:1]
    elif takes == "few":
        pool = pool[:limit]
    return [n for _, n in pool]


def frames(spark, asks, facts):
    f = spark.createDataFrame([(n, a, r, b, t, t.date() if t else None) for n, a, r, b, t in facts], "line_no long, s string, r string, o string, ts timestamp_ntz, d date")
    return spark.createDataFrame(asks, ASKS), f


def test_equals_a_plain_reading(spark):
    rng = random.Random(1)
    at = lambda: dt.datetime.combine(DAY, dt.time()) + dt.timedelta(days=rng.randrange(80), hours=rng.choice((0, 0, 5)))
    facts = [(i, rng.choice("ABC"), rng.choice("xy"), rng.choice("PQ"), at() if rng.random() < 0.95 else None) for i in range(400)]
    asks = []
    for i in range(500):
        end = rng.choice("ABCZ"), None
        s, o = end if rng.random() < 0.5 else end[::-1]
        side, takes = rng.choice([(None, "all"), (None, "day"), (0, "all"), (0, "one"), (-1, "few"), (1, "few"), (-1, "day"), (1, "day"), (0, "few"), (None, "few"), (None, "one")])
        asks.append((i, rng.choice("xyz"), s, rng.choice("PQ") if o and rng.random() < 0.8 else o, rng.choice(("year", "month", "day", "day", "week")), DAY + dt.timedelta(days=rng.randrange(-5, 90)) if rng.random() < 0.95 else None, side, takes, rng.random() < 0.5))
    asks += [(900, "x", None, None, "day", DAY, 0, "all", False), (901, "x", "A", "P", "day", DAY, 0, "all", False)]
    got = {}
    for r in pool_rows(*frames(spark, asks, facts), limit=3).orderBy("quid", "ord").collect():
        got.setdefault(r.quid, []).append(r.line_no)
        assert (r.fs == r.s or r.fo == r.o) and r.fr == r.rel
    assert got == {a[0]: p for a in asks if (p := plain(a, facts, 3))} and len(got) > 200


def test_a_hub_asked_by_many_meets_only_what_is_taken(spark):
    """10,000 questions on one pool of 4,000 facts: 40 million pairs, of which ten a question are taken."""
    start = dt.datetime(2020, 1, 1)
    facts = [(i, "HUB", "x", f"o{i}", start + dt.timedelta(hours=7 * i)) for i in range(4000)]
    asks = [(i, "x", "HUB", None, "day", (start + dt.timedelta(hours=2 * i)).date(), 1, "few", False) for i in range(10_000)]
    rows = pool_rows(*frames(spark, asks, facts), limit=10)
    met = [int(v) for v in _join_rows(rows)]
    assert rows.count() == 100_000 and met and max(met) < 2_000_000
    assert [r.line_no for r in rows.where("quid = 5000").orderBy("ord").collect()] == plain(asks[5000], facts, 10)


def _join_rows(rows):
    """Rows that the plan's joins give, as they are counted when it runs."""
    rows.count()
    plan = rows._jdf.queryExecution().executedPlan()
    rows.collect()
    found, todo = [], [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().get("numOutputRows").get().value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_empty(spark):
    asks, facts = frames(spark, [(1, "x", "A", None, "day", DAY, 0, "all", False)], [(1, "A", "x", "P", dt.datetime(2023, 11, 20))])
    assert pool_rows(asks.limit(0), facts).count() == 0 and pool_rows(asks, facts.limit(0)).count() == 0
    assert pool_rows(asks, facts).count() == 1


def test_rows_are_numbered_by_their_places_and_not_shuffled_again(spark):
    start = dt.datetime(2020, 1, 1)
    facts = [(i, "HUB", "x", f"o{i}", start + dt.timedelta(hours=7 * i)) for i in range(300)]
    asks = [(i, "x", "HUB", None, level, (start + dt.timedelta(days=i)).date(), side, takes, i % 2 == 0) for i, (level, side, takes) in enumerate([("month", 0, "all"), ("day", 1, "day"), ("day", -1, "few"), ("day", -1, "day"), ("month", 0, "one"), ("year", None, "day")] * 4)]
    asked, known = frames(spark, asks, facts)
    by_quid = {}
    for r in pool_rows(asked, known).collect():
        by_quid.setdefault(r.quid, []).append((r.pos, r.line_no))
    assert {q: sorted(rows) for q, rows in by_quid.items()} == {a[0]: list(enumerate(p, 1)) for a in asks if (p := plain(a, facts, 10))}
    q = spark.createDataFrame([(1, 1, "x", "HUB", None, "month", start.date(), ["2020-01"], "equal", "entity")], "quid long, cand_rank int, rel string, s string, o string, time_level string, t date, time array<string>, qtype string, answer_type string")
    rows = retrieve.equal_entity(q, known)
    assert "windowspecdefinition(quid" not in rows._jdf.queryExecution().toString() and rows.count() > 60
