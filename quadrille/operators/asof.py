"""As-of retrieval from pools by places.

The facts of the pools that are asked for are numbered in time order.  What a question takes is then an interval of places or
the facts of one day: how many facts lie before its period, and before the period's end, is found by one pass over facts and
points in time, sorted together, so a question never meets the facts that it does not take.  No task holds a whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import truncate
from ..sources.scratch import stored
from .place import placed

POOL = ("kind", "end", "rel")
#: Places that an interval is joined by.
BLOCK = 64
#: Behind all days.
ALWAYS = (1 << 31) - 1


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def _period(at: Column, level: Column) -> tuple[Column, Column]:
    """The first day of a date's period and of the next one, as numbers; null for an unknown level or date."""
    first = truncate(at, level)
    following = F.when(level == "year", F.add_months(first, 12)).when(level == "month", F.add_months(first, 1)).otherwise(F.date_add(first, 1))
    return day_number(first), day_number(following)


def places_before(points: DataFrame, numbered: DataFrame) -> DataFrame:
    """(kind, end, rel, t, before): for each different point (pool, t) how many facts of the pool are of days before t.

    Points and facts are dealt by ranges of pool and time; the count goes on from range to range."""
    marks = numbered.select(*POOL, day_number(F.col("fd")).alias("t"), F.lit(1).alias("is_fact"), "place")
    events = points.select(*POOL, "t", F.lit(0).alias("is_fact"), F.lit(None).cast("long").alias("place")).unionAll(marks.withColumn("place", F.col("place").cast("long")))
    order = ("t", "is_fact")
    dealt = stored(events.repartitionByRange(*POOL, *order).withColumn("range_", F.spark_partition_id()))
    upto = W.partitionBy(*POOL, "range_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = dealt.withColumn("own", F.max("place").over(upto)).where("is_fact = 0")
    tops = dealt.groupBy(*POOL, "range_").agg(F.max("place").alias("top"))
    earlier = W.partitionBy(*POOL).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*POOL, "range_", F.max("top").over(earlier).alias("carried"))
    return local.join(carried, [*POOL, "range_"]).select(*POOL, "t", F.coalesce(F.greatest("own", "carried"), F.lit(0)).alias("before"))


def pool_rows(asks: DataFrame, facts: DataFrame, limit: int = 10) -> DataFrame:
    """The facts that each question takes of its pool, numbered by their places from 1, so that what is taken, which may be far more
    than facts and questions, is not shuffled again; ``asks`` as in ``pool_spans``, columns as of ``rows_of``."""
    return rows_of(*pool_spans(asks, facts, limit))


def pool_spans(asks: DataFrame, facts: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """The columns of ``asks`` and kind, end, begin_, stop_: the places of its pool that each question takes, if any; and the pools' numbered facts.

    ``asks``: quid, rel, s or o (the known end), time_level, at, side, takes, take_last.  side: -1, 0 or 1 for facts before, in or
    after the period of ``at``, null for the whole pool.  takes: "all"; "one", the first or last; "few", the first ``limit``;
    "day", those of the last day before, the first day after, or the first or last of all.  Ties in time go by line."""
    ask_columns = asks.columns
    first, following = _period(F.col("at"), F.col("time_level"))
    side, takes = F.col("side"), F.col("takes")
    known = asks.where("(s is null) <> (o is null)").select(
        "*", F.when(F.col("s").isNotNull(), F.lit("s")).otherwise(F.lit("o")).alias("kind"), F.coalesce("s", "o").alias("end"),
        F.when(side <= 0, first).alias("t1"), F.when(side.isNull(), F.lit(ALWAYS)).when(side >= 0, following).alias("t2"),
    )
    known = stored(known.where("t1 is not null or t2 is not null"))
    f = facts.where("ts is not null").select(F.col("s").alias("fs"), F.col("r").alias("fr"), F.col("o").alias("fo"), F.col("d").alias("fd"), F.col("ts").alias("fts"), "line_no")
    ends = F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("fs").alias("end")), F.struct(F.lit("o").alias("kind"), F.col("fo").alias("end"))))
    pooled = f.select("*", ends.alias("x")).select("*", "x.*", F.col("fr").alias("rel")).drop("x").join(known.select(*POOL).distinct(), list(POOL), "left_semi")
    numbered = stored(placed(pooled, POOL, ("fts", "line_no")))
    points = known.select(*POOL, F.explode(F.array_compact(F.array("t1", "t2"))).alias("t")).distinct()
    before = places_before(points, numbered)
    at_ = lambda n: before.withColumnsRenamed({"t": f"t{n}", "before": f"p{n}"})
    q = known.join(at_(1), [*POOL, "t1"], "left").join(at_(2), [*POOL, "t2"], "left")
    p1, p2, last = F.coalesce("p1", F.lit(0)), F.col("p2"), F.col("take_last")
    few = F.when(side < 0, F.lit(1)).when(side == 0, p1 + 1).when(side > 0, p2 + 1).otherwise(F.lit(1)), F.when(side < 0, p1).when(side > 0, p2 + limit).otherwise(p2)
    one = F.when(last, few[1]).otherwise(few[0])
    begin = F.when(takes == "one", F.when(few[0] <= few[1], one)).when(takes != "day", few[0])
    stop = F.when(takes == "one", one).when(takes == "few", F.least(few[1], few[0] + limit - 1)).otherwise(few[1])
    edge = F.when(side < 0, p1).when(side > 0, p2 + 1).when(side == 0, F.when(few[0] <= few[1], one)).otherwise(F.when(last, p2).otherwise(F.lit(1)))
    placed_q = q.select(*ask_columns, "kind", "end", begin.alias("begin_"), stop.alias("stop_"), F.when(takes == "day", edge).alias("edge_"))
    # The facts of a day are an interval of places, too.
    day_of = numbered.select(*POOL, F.col("place").alias("edge_"), F.col("fd").alias("day_"))
    bounds = numbered.groupBy(*POOL, F.col("fd").alias("day_")).agg(F.min("place").alias("begin_"), F.max("place").alias("stop_"))
    days = placed_q.where("edge_ >= 1").drop("begin_", "stop_").join(day_of, [*POOL, "edge_"]).join(bounds, [*POOL, "day_"])
    return placed_q.where("begin_ <= stop_").drop("edge_").unionByName(days.drop("day_", "edge_")), numbered


def rows_of(placed_q: DataFrame, numbered: DataFrame) -> DataFrame:
    """The other columns of ``placed_q`` and fs, fr, fo, fd, fts, line_no, ord, pos: the facts of spans of places."""
    ask_columns = [c for c in placed_q.columns if c not in ("kind", "end", "begin_", "stop_")]
    rows = numbered.withColumn("block_", F.expr(f"place div {BLOCK}"))
    spans = placed_q.select("*", F.explode(F.sequence(F.expr(f"begin_ div {BLOCK}"), F.expr(f"stop_ div {BLOCK}"))).alias("block_"))
    taken = spans.join(rows, [*POOL, "block_"]).where("place between begin_ and stop_")
    return taken.select(*ask_columns, "fs", "fr", "fo", "fd", "fts", "line_no", F.struct("fts", "line_no").alias("ord"), (F.col("place") - F.col("begin_") + 1).cast("int").alias("pos"))
