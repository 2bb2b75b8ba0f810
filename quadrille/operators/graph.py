"""The temporal multigraph as an edge table: orders, indexes, lookups, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .place import placed
from .union import united


def timed(facts: DataFrame) -> DataFrame:
    return facts.where("ts is not null")


def ingest_order(facts: DataFrame) -> DataFrame:
    """``facts`` with ord, the position an insertion-ordered graph gives: by the first appearance
    of the subject as a node, then by the first line of its pair with the object, then by line.

    Static edges count for both.  First lines are aggregated before they are joined back, so a
    hub is never one window."""
    pairs = facts.groupBy("s", "o").agg(F.min("line_no").alias("pair_seq"))
    ends = facts.select(F.explode(F.array(F.struct(F.col("s").alias("n"), (2 * F.col("line_no")).alias("k")), F.struct(F.col("o").alias("n"), (2 * F.col("line_no") + 1).alias("k")))).alias("e"))
    nodes = ends.groupBy(F.col("e.n").alias("s")).agg(F.min("e.k").alias("node_seq"))
    out = facts.join(pairs, ["s", "o"]).join(nodes, "s")
    return out.withColumn("ord", F.struct("node_seq", "pair_seq", "line_no")).drop("pair_seq", "node_seq")


def ordered(facts: DataFrame, order: str = "time") -> DataFrame:
    """Timed facts with ord: (ts, line_no) for order "time", else as they were read ("ingest")."""
    if order == "ingest":
        return timed(ingest_order(facts))
    return timed(facts).withColumn("ord", F.struct("ts", "line_no"))


def index(facts: DataFrame, keys: tuple[str, str], order: str = "time", rows: int = 4096) -> DataFrame:
    """keys, part, first, size and facts: each pool's facts (ord, s, r, o, d, line_no) in order.

    A pool is a row, as in a hash index, or several: part 0, 1, … of at most ``rows`` facts each, ``first`` being the
    place of a part's first fact, so a hub's pool is in no task as a whole.  Retrieval joins the fact table instead."""
    numbered = placed(ordered(facts, order), keys, ["ord"])
    part = F.expr(f"cast((place - 1) div {rows} as int)")
    held = F.sort_array(F.collect_list(F.struct("ord", "s", "r", "o", "d", "line_no")))
    return numbered.groupBy(*keys, part.alias("part")).agg((F.min("place") - 1).alias("first"), F.count("*").alias("size"), held.alias("facts"))


def subject_index(facts: DataFrame, order: str = "time") -> DataFrame:
    return index(facts, ("s", "r"), order)


def object_index(facts: DataFrame, order: str = "time") -> DataFrame:
    return index(facts, ("r", "o"), order)


def pool_summary(facts: DataFrame, keys: tuple[str, str], order: str = "time") -> DataFrame:
    """keys, size, first_line, last_line of each pool, without building the pool."""
    return ordered(facts, order).groupBy(*keys).agg(F.count("*").alias("size"), F.min_by("line_no", "ord").alias("first_line"), F.max_by("line_no", "ord").alias("last_line"))


def statistics(facts: DataFrame) -> DataFrame:
    """edges, timed_edges, nodes, subj_keys, obj_keys.  Nodes are one distinct aggregate over an
    exploded pair, so both ends are read in one scan."""
    nodes = facts.select(F.explode(F.array("s", "o")).alias("n")).agg(F.countDistinct("n").alias("nodes"))
    rest = facts.agg(
        F.count("*").alias("edges"),
        F.count("ts").alias("timed_edges"),
        F.countDistinct(F.when(F.col("ts").isNotNull(), F.struct("s", "r"))).alias("subj_keys"),
        F.countDistinct(F.when(F.col("ts").isNotNull(), F.struct("r", "o"))).alias("obj_keys"),
    )
    return rest.join(nodes)


def edges_between(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Each wanted pair (quid, s, o) with all its edges; pos in order of lines from 1."""
    found = pairs.join(facts.select("s", "o", "r", "d", "line_no"), ["s", "o"])
    return found.withColumn("pos", F.row_number().over(W.partitionBy("quid", "s", "o").orderBy("line_no")).cast("int"))


def edges_with_relation(triples: DataFrame, facts: DataFrame) -> DataFrame:
    return triples.join(facts.select("s", "r", "o", "d", "line_no"), ["s", "r", "o"])


def pools(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each wanted pool; keys without facts keep one row of nulls.

    ``wanted``: quid, s (or null), r, o (or null); the known side is the key.  Two equi-joins are
    united; an OR of both would compare every question with every fact."""
    f = facts.select("s", "r", "o", "d", "ts", "line_no")
    by_s = wanted.where("s is not null and o is null").drop("o").join(f, ["s", "r"], "left")
    by_o = wanted.where("o is not null and s is null").drop("s").join(f, ["r", "o"], "left")
    return united(by_s, by_o)
