"""Logical views over the test tables, as DataFrames and as SQL for the oracle.

facts_ev: events as (user, event type, key, day).  questions: every 37th event as a question about itself.
pools: all order lines as (supplier, flags, brand, ship day) by supplier, with a cue and an anchor each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.place import spread_by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_facts(table(spark, sf_dir, "events"))


def as_facts(events: DataFrame) -> DataFrame:
    d = F.col("ts").cast("date")
    return events.select(
        F.col("event_id").alias("line_no"), F.concat(F.lit("user_"), "user_id").alias("s"), F.col("event_type").alias("r"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("o"), d.cast("timestamp_ntz").alias("ts"), d.alias("d"),
    )


FACTS_EV = """facts AS (SELECT event_id AS line_no, 'user_' || user_id AS s, event_type AS r, 'k' || json_extract_string(props, '$.k') AS o,
 CAST(ts AS DATE) AS d FROM events)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six types; the known side, level, direction and explicit time vary with the number."""
    f = facts_ev(spark, sf_dir).where("line_no % 37 = 0").withColumn("n", F.expr("line_no div 37"))

    def pick(div: int, *values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"n div {div}") % len(values) + 1).cast("int"))

    f = f.withColumn("qtype", pick(1, "equal", "equal_multi", "first_last", "before_after", "before_last", "after_first"))
    f = f.withColumn("side", F.expr("n div 6") % 2).withColumn("level", pick(12, "day", "month", "year")).withColumn("dir", F.expr("n div 36") % 2).withColumn("timed", F.expr("n div 72") % 2)
    both = F.col("qtype").isin("equal", "first_last") & (F.col("n") % 5 == 0)
    none = F.lit("None")
    length = F.when(F.col("level") == "day", 10).when(F.col("level") == "month", 7).otherwise(4)
    day = F.substr(F.col("d").cast("string"), F.lit(1), length)
    word = (
        F.when(F.col("qtype") == "equal", F.lit("in"))
        .when(F.col("qtype") == "equal_multi", F.when((F.col("timed") == 0), F.lit("the same")).when(F.col("dir") == 0, F.lit("first")).otherwise(F.lit("last")))
        .when(F.col("qtype") == "first_last", F.when(F.col("dir") == 0, F.lit("first")).otherwise(F.lit("last")))
        .when(F.col("qtype") == "before_after", F.when(F.col("dir") == 0, F.lit("before")).otherwise(F.lit("after")))
        .when(F.col("qtype") == "before_last", F.lit("last before"))
        .otherwise(F.lit("first after"))
    )
    timed = (F.col("timed") == 1) | (F.col("qtype") == "equal")
    return f.select(
        F.col("line_no").alias("quid"),
        F.concat(F.lit("What was "), word, F.lit(" "), "s", F.lit("?")).alias("question"),
        F.array(F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("s"))).alias("answers"),
        F.when(both, F.lit("time")).otherwise(F.lit("entity")).alias("answer_type"),
        F.col("level").alias("time_level"), "qtype", F.when(F.col("n") % 3 == 0, "Multiple").otherwise("Single").alias("qlabel"),
        F.when(timed, F.array(day)).otherwise(F.array().cast("array<string>")).alias("time"),
        F.array("s", "o").alias("entities"),
        F.when(both | (F.col("side") == 0), F.col("s")).otherwise(none).alias("subject"),
        F.col("r").alias("relation"),
        F.when(both | (F.col("side") == 1), F.col("o")).otherwise(none).alias("object"),
        word.alias("cue"),
        F.when(F.col("side") == 0, F.col("o")).otherwise(F.col("s")).alias("reference_target"),
    )


QUESTIONS = """picked AS (SELECT *, line_no // 37 AS n FROM facts WHERE line_no % 37 = 0),
typed AS (SELECT *, ['equal','equal_multi','first_last','before_after','before_last','after_first'][n % 6 + 1] AS qtype, (n // 6) % 2 AS side,
 ['day','month','year'][(n // 12) % 3 + 1] AS level, (n // 36) % 2 AS dir, (n // 72) % 2 AS timed FROM picked),
worded AS (SELECT *, qtype IN ('equal','first_last') AND n % 5 = 0 AS both_, CASE qtype WHEN 'equal' THEN 'in' WHEN 'equal_multi' THEN
 CASE WHEN timed = 0 THEN 'the same' WHEN dir = 0 THEN 'first' ELSE 'last' END WHEN 'first_last' THEN CASE WHEN dir = 0 THEN 'first' ELSE 'last' END
 WHEN 'before_after' THEN CASE WHEN dir = 0 THEN 'before' ELSE 'after' END WHEN 'before_last' THEN 'last before' ELSE 'first after' END AS word FROM typed),
q AS (SELECT line_no AS quid, 'What was ' || word || ' ' || s || '?' AS question, CASE WHEN side = 0 THEN o ELSE s END AS answer,
 CASE WHEN both_ THEN 'time' ELSE 'entity' END AS answer_type, level, qtype, CASE WHEN n % 3 = 0 THEN 'Multiple' ELSE 'Single' END AS qlabel,
 CASE WHEN timed = 1 OR qtype = 'equal' THEN date_trunc(level, d) END AS t, CASE WHEN both_ OR side = 0 THEN s END AS s, r AS rel,
 CASE WHEN both_ OR side = 1 THEN o END AS o, CASE WHEN side = 0 THEN o ELSE s END AS ref, word, s AS own_s, o AS own_o, d AS own_d FROM worded)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's own relation and the next one by name."""
    q = questions(spark, sf_dir).select("quid", "relation")
    names = facts_ev(spark, sf_dir).select("r").distinct()
    after = names.withColumn("next", F.lead("r").over(W.orderBy("r"))).join(names.agg(F.min("r").alias("least")))
    pairs = after.select(F.col("r").alias("relation"), F.explode(F.array(F.struct(F.lit(1).alias("cand_rank"), F.col("r").alias("rel")), F.struct(F.lit(2).alias("cand_rank"), F.coalesce("next", "least").alias("rel")))).alias("c"))
    return q.join(pairs, "relation").select("quid", "c.cand_rank", "c.rel")


CANDIDATES = """names AS (SELECT r, coalesce(lead(r) OVER (ORDER BY r), min(r) OVER ()) AS nxt FROM (SELECT DISTINCT r FROM facts)),
qc AS (SELECT q.* EXCLUDE (rel), 1 AS cand_rank, q.rel AS rel FROM q UNION ALL SELECT q.* EXCLUDE (rel), 2 AS cand_rank, names.nxt AS rel FROM q JOIN names ON names.r = q.rel)"""

BASE = f"WITH {FACTS_EV},\n{QUESTIONS},\n{CANDIDATES}"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary: all ends of facts but users whose number is a multiple of 11."""
    f = facts_ev(spark, sf_dir)
    names = f.select(F.explode(F.array("s", "o")).alias("name")).distinct()
    return names.where("name not like 'user_%' or cast(substr(name, 6) as bigint) % 11 <> 0")


ENTITIES = """ents AS (SELECT DISTINCT name FROM (SELECT s AS name FROM facts UNION ALL SELECT o FROM facts)
 WHERE name NOT LIKE 'user_%' OR CAST(substr(name, 6) AS BIGINT) % 11 <> 0)"""


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quid, pos, s, r, o, d): the supplier's order lines, in order of order, line, part and ship day."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    l = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    place = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    return spread_by(l, lines.count(), "l_suppkey").select(
        F.col("l_suppkey").alias("quid"), F.row_number().over(place).cast("int").alias("pos"), F.concat(F.lit("S"), "l_suppkey").alias("s"),
        F.concat("l_returnflag", "l_linestatus").alias("r"), F.col("p_brand").alias("o"), F.col("l_shipdate").cast("date").alias("d"),
    )


def pool_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quid, cue, anchor, target) of each supplier; every fifth has no anchor, every sixth no cue."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("quid"))
    cue = F.get(F.array(F.lit("before"), F.lit("after"), F.lit("first"), F.lit("last"), F.lit("same")), (F.col("quid") % 6).cast("int"))
    anchor = F.when(F.col("quid") % 5 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("quid") * 37 % 1500 - 700).cast("int")))
    return s.select("quid", cue.alias("cue"), anchor.alias("anchor"), F.when(F.col("quid") % 7 == 0, F.lit("NO")).alias("target"))


POOLS = """WITH pool AS (SELECT l_suppkey AS quid, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity) AS INTEGER) AS pos,
 'S' || l_suppkey AS s, l_returnflag || l_linestatus AS r, p_brand AS o, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
cues AS (SELECT s_suppkey AS quid, ['before','after','first','last','same'][s_suppkey % 6 + 1] AS cue,
 CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey * 37 % 1500 - 700 AS INTEGER) END AS anchor, CASE WHEN s_suppkey % 7 = 0 THEN 'NO' END AS target FROM supplier)"""
