"""Places inside groups of any size, and rows dealt by their number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import stored

#: About so many rows are sorted or grouped in one task.
TASK_ROWS = 1 << 19


def spread_by(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n`` of them, by hash of ``keys``, in more partitions than the session's where those would hold
    more than ``TASK_ROWS`` rows each: what a task sorts does not grow with the table."""
    parts = -(-n // TASK_ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their range of keys and order (range_), written, and those of groups that span ranges: at most two groups a range."""
    dealt = stored(rows.dropna(subset=list(keys)).repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))
    spanning = dealt.groupBy(*keys).agg(F.min("range_").alias("lo_"), F.max("range_").alias("hi_")).where("lo_ < hi_").select(*keys)
    return dealt, dealt.join(F.broadcast(spanning), list(keys), "left_semi")


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, the place (from 1) inside their group of ``keys`` by ``order``.

    Rows are dealt by ranges of keys and order and written, numbered in each range, and the numbers of a group that
    spans ranges go on from range to range, so no task holds a whole group.  Rows with a null key are left out."""
    dealt, spanning = _ranged(rows, keys, order)
    up = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    before = stored(spanning.groupBy(*keys, "range_").agg(F.count("*").alias("n_")).select(*keys, "range_", F.coalesce(F.sum("n_").over(up), F.lit(0)).alias("before_")))
    local = spread_by(dealt, dealt.count(), *keys, "range_").withColumn(name, F.row_number().over(W.partitionBy(*keys, "range_").orderBy(*order)))
    return local.join(F.broadcast(before), [*keys, "range_"], "left").withColumn(name, F.col(name) + F.coalesce("before_", F.lit(0))).drop("range_", "before_")


def followed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], least: str) -> tuple[DataFrame, int]:
    """``rows`` with place, next_ (``columns`` of the row that follows in the group, null behind the last) and least_ (the least
    ``least`` of the group), and how many they are.

    A row and the next one stand in the same range, but for the last of a range: the first of each range of a group that
    spans several is looked up.  Rows with equal ``order`` follow each other by ``columns``."""
    dealt, spanning = _ranged(rows, keys, order)
    n, by = dealt.count(), [*order, *columns]
    first = F.min(F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.struct(*columns).alias("row"))).alias("first_")
    own = spanning.groupBy(*keys, "range_").agg(F.count("*").alias("n_"), first, F.min(least).alias("own_"))
    whole = W.partitionBy(*keys)
    steps = whole.orderBy("range_")
    edges = stored(own.select(
        *keys, "range_", F.coalesce(F.sum("n_").over(steps.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"),
        F.lead("first_.row").over(steps).alias("then_"), F.min("own_").over(whole).alias("all_"),
    ))
    here = W.partitionBy(*keys, "range_")
    local = spread_by(dealt, n, *keys, "range_").withColumn("place", F.row_number().over(here.orderBy(*by)))
    local = local.withColumn("next_", F.lead(F.struct(*columns)).over(here.orderBy(*by))).withColumn("least_", F.min(least).over(here))
    met = local.join(F.broadcast(edges), [*keys, "range_"], "left")
    met = met.withColumn("place", F.col("place") + F.coalesce("before_", F.lit(0))).withColumn("next_", F.coalesce("next_", "then_")).withColumn("least_", F.coalesce("all_", "least_"))
    return met.drop("range_", "before_", "then_", "all_"), n
