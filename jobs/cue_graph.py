"""Grows the cue graph as events arrive: which fact follows which, for the same object and relation.

    python -m jobs.cue_graph --events DIR --out DIR --checkpoint DIR [--config jobs/cue_graph.json]

Event files come as a stream whose checkpoint says which are done; all that is new is taken, then the job ends.  Tables, all
Parquet by month: ``arrivals`` (events as they came, by month and batch), ``facts`` (each once), ``lasts`` (the last fact of each
object and relation in a month), ``edges`` (in the month of the later fact).  A batch writes the months of its facts anew and
the edges from its earliest month on; what lies before is seen only through ``lasts``, a row for each month, object and
relation.  A late fact so parts the edge that it falls into.  Each step overwrites whole partitions, so a batch that died is
repeated without a trace.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import run
from quadrille.operators.cue import after_edges
from quadrille.plans.views import as_facts
from quadrille.sources.scratch import scratch_scope

log = logging.getLogger(__name__)

FACT = "line_no long, s string, r string, o string, ts timestamp_ntz, d date"
ARRIVALS = f"{FACT}, month string, batch long"
FACTS = f"{FACT}, month string"
EDGES = "src string, dst string, edge_key string, cue string, relation string, time_1 string, time_2 string, fact_1 string, fact_2 string, center string, mode string, month string"
KEY = {"obj": ["o", "r"], "subj": ["s", "r"]}


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Overwrites the partitions that ``rows`` have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _by_month(rows: DataFrame, *keys: str, files: int) -> DataFrame:
    return rows.repartition("month", F.pmod(F.xxhash64(*keys), F.lit(files)))


def grow(events: DataFrame, batch: int, out: str, mode: str, files: int) -> dict:
    """Takes one batch of events into the tables below ``out``."""
    spark, key = events.sparkSession, KEY[mode]
    facts = as_facts(events).where("d is not null and s is not null and r is not null and o is not null")
    _replace(facts.withColumn("month", F.date_format("d", "yyyy-MM")).withColumn("batch", F.lit(batch)), f"{out}/arrivals", "month", "batch")
    all_arrivals = spark.read.schema(ARRIVALS).parquet(f"{out}/arrivals")
    arrived = {r.month: r.n for r in all_arrivals.where(F.col("batch") == batch).groupBy("month").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = {"batch": batch, "events": events.count(), "facts": sum(arrived.values()), "months": len(arrived), "edges": 0}
    if arrived:
        months = sorted(arrived)
        first = F.lit(months[0])
        columns = [c for c in all_arrivals.columns if c not in ("month", "batch")]
        once = all_arrivals.where(F.col("month").isin(months)).groupBy("month", "line_no").agg(F.min(F.struct(*[c for c in columns if c != "line_no"])).alias("x")).select(*[F.col(c if c == "line_no" else f"x.{c}").alias(c) for c in columns], "month")
        _replace(_by_month(once, "line_no", files=files), f"{out}/facts", "month")
        stored = spark.read.schema(FACTS).parquet(f"{out}/facts")
        latest = F.max_by(F.struct(*columns), F.struct("ts", "line_no")).alias("x")
        _replace(stored.where(F.col("month").isin(months)).groupBy("month", *key).agg(latest).select("x.*", "month").coalesce(files), f"{out}/lasts", "month")
        lasts = spark.read.schema(FACTS).parquet(f"{out}/lasts")
        carried = lasts.where(F.col("month") < first).groupBy(*key).agg(latest).select("x.*")
        touched = stored.where(F.col("month") >= first).select(*columns).unionByName(carried)
        with scratch_scope():
            edges = after_edges(touched, mode).drop("write_seq").withColumn("month", F.substring("time_2", 1, 7))
            _replace(_by_month(edges, "center", "relation", "time_2", files=files), f"{out}/edges", "month")
        done["edges"] = read_edges(spark, out).where(F.col("month") >= first).count()
    log.info("batch %(batch)d: read %(events)d events, %(facts)d with a fact, in %(months)d months; wrote %(edges)d edges", done)
    return done


def grow_cue_graph(spark: SparkSession, events: str, out: str, checkpoint: str, mode: str = "obj", max_files: int = 1000, files: int = 16) -> dict:
    """Takes the event files that are new since the last run into the tables below ``out``.

    ``mode``: facts follow each other for the same object ("obj") or subject ("subj"); ``max_files``: event files a batch;
    ``files``: files a month.  An event that comes twice in a month counts once; events without subject, type, object or time
    have no fact."""
    # As a pattern the path may be a folder or a single file; a stream takes the plain path of a folder only.
    path = events.rstrip("/")
    pattern = path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
    done: list[dict] = []

    def batch(df: DataFrame, number: int) -> None:
        done.append(grow(df, number, out, mode, files))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    total = {k: sum(d[k] for d in done) for k in ("events", "facts", "edges")} | {"batches": len(done)}
    log.info("%s: %d batches, %d events, %d facts, %d edges written to %s", events, total["batches"], total["events"], total["facts"], total["edges"], out)
    return total


def read_edges(spark: SparkSession, out: str) -> DataFrame:
    """The edges as they stand, each from a fact to the one that follows it."""
    return spark.read.schema(EDGES).parquet(f"{out}/edges")


if __name__ == "__main__":
    run(grow_cue_graph, {"events": "Parquet files of events", "out": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"})
