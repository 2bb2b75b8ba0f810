"""The cue graph: consecutive facts of a centre as "after" edges, mirrored as "before"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import render_fact
from .graph import ordered
from .place import followed, spread_by


def _pairs(facts: DataFrame, mode: str, order: str) -> tuple[DataFrame, int]:
    """Each fact of a (centre, relation) group with the next in time, in few columns, and about how many."""
    center, end = ("o", "s") if mode == "obj" else ("s", "o")
    base = ordered(facts, order).select(F.col(center).alias("center"), F.col("r").alias("relation"), F.col(end).alias("end"), "ts", "ord", "d")
    rows, n = followed(base, ["center", "relation"], ["ts", "ord"], ["end", "ts", "d"], "ord")
    return rows.where("next_ is not null").select(
        "center", "relation", F.col("end").alias("src"), F.col("next_.end").alias("dst"), F.col("ts").alias("ts_1"), F.col("next_.ts").alias("ts_2"),
        F.col("d").alias("d_1"), F.col("next_.d").alias("d_2"), F.struct(F.col("least_").alias("group_seq"), "place", F.lit(0).alias("side")).alias("write_seq"),
    ), n


def _time(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def _rendered(pairs: DataFrame, mode: str, cue: Column) -> list[Column]:
    """The columns of an edge but for its write_seq."""

    def fact(end: str, d: str) -> Column:
        s, o = (end, "center") if mode == "obj" else ("center", end)
        return render_fact(F.col(s), F.col("relation"), F.col(o), F.col(d))

    one, two = _time("ts_1"), _time("ts_2")
    return [
        F.col("src"), F.col("dst"), F.concat_ws("_", "relation", one, two).alias("edge_key"), cue.alias("cue"), F.col("relation"), one.alias("time_1"), two.alias("time_2"),
        fact("src", "d_1").alias("fact_1"), fact("dst", "d_2").alias("fact_2"), F.col("center"), F.lit(mode).alias("mode"),
    ]


def after_edges(facts: DataFrame, mode: str = "obj", order: str = "time") -> DataFrame:
    """An edge from each fact of a (centre, relation) group to the next in time.

    mode "obj": groups by object, edges between subjects; "subj": the reverse.  Within a group
    write_seq orders the edges as they are written: group, place, 0 for after and 1 for before.
    Facts meet their successor inside ranges of a group, so a hub's group is in no task as a whole."""
    pairs, _ = _pairs(facts, mode, order)
    return pairs.select(*_rendered(pairs, mode, F.lit("after")), "write_seq")


def before_edges(after: DataFrame) -> DataFrame:
    """The mirror of each "after" edge: ends, times and facts change places."""
    return after.select(
        F.col("dst").alias("src"),
        F.col("src").alias("dst"),
        F.concat_ws("_", "relation", "time_2", "time_1").alias("edge_key"),
        F.lit("before").alias("cue"),
        "relation",
        F.col("time_2").alias("time_1"),
        F.col("time_1").alias("time_2"),
        F.col("fact_2").alias("fact_1"),
        F.col("fact_1").alias("fact_2"),
        "center",
        "mode",
        F.struct("write_seq.group_seq", "write_seq.place", F.lit(1).alias("side")).alias("write_seq"),
    )


def _turned(rows: DataFrame, turned: Column) -> DataFrame:
    """Pairs whose ends, times and days change places where ``turned``."""
    swaps = {x: y for a, b in (("src", "dst"), ("ts_1", "ts_2"), ("d_1", "d_2")) for x, y in ((a, b), (b, a))}
    return rows.withColumns({x: F.when(turned, F.col(y)).otherwise(F.col(x)) for x, y in swaps.items()})


def cue_graph(facts: DataFrame, mode: str = "obj", order: str = "time") -> DataFrame:
    """Both directions; of edges with the same ends and key the last written stays.

    A key names both times, the earlier first in "after" edges and last in "before" edges, so edges of different directions meet
    only where the times are equal.  Of other pairs one direction is compared and the winner mirrored; texts are made from what stays.
    The upsert is an aggregate, not a window."""
    pairs, n = _pairs(facts, mode, order)
    twin = _time("ts_1") == _time("ts_2")
    both = pairs.withColumn("side", F.explode(F.when(twin, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = _turned(both, F.col("side") == 1).withColumn("edge_key", F.concat_ws("_", "relation", _time("ts_1"), _time("ts_2")))
    rest, seq = ["center", "relation", "ts_1", "ts_2", "d_1", "d_2", "side"], F.struct("write_seq.group_seq", "write_seq.place", "side")
    keyed = spread_by(both.select("src", "dst", "edge_key", F.struct(*rest).alias("row"), F.struct(seq.alias("write_seq"), "center").alias("seq")), n, "src", "dst", "edge_key")
    kept = keyed.groupBy("src", "dst", "edge_key").agg(F.max_by("row", "seq").alias("row")).select("src", "dst", "row.*")
    mirrored = kept.withColumn("to", F.explode(F.when(twin, F.array("side")).otherwise(F.array(F.lit(0), F.lit(1)))))
    out = _turned(mirrored, ~twin & (F.col("to") == 1))
    return out.select(*_rendered(out, mode, F.when(F.col("to") == 0, F.lit("after")).otherwise(F.lit("before"))))
