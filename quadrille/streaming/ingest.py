"""Streaming: append-only fact ingest, running counts by window, chunked answering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import parse_quads


def stream_quads(spark: SparkSession, path: str, names: str = "space") -> DataFrame:
    """Facts of text files as they arrive in a folder; line numbers are hashes of file and line."""
    lines = spark.readStream.text(path).select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("line_no"), F.col("value").alias("line"))
    return parse_quads(lines, names)


def write_stream(facts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends facts to a table exactly once, all that is there and then stops."""
    return facts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(facts: DataFrame, late: str = "7 days", width: str = "30 days") -> DataFrame:
    """Facts by relation and tumbling window of their time; a window closes ``late`` after it."""
    timed = facts.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "r").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "r", "n")


def answer_chunk(questions: DataFrame, chunk: int, answer: Callable[[DataFrame], DataFrame], out: str, key: str = "quid") -> None:
    """Answers one chunk into its own partition of ``out``, which it overwrites: a chunk that is run again adds nothing twice, and
    no earlier result is read.  A question that stands in a chunk twice is answered once."""
    rows = answer(questions.dropDuplicates([key])).withColumn("chunk", F.lit(chunk).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(out)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers questions chunk by chunk, as they arrive; the stream's checkpoint says which chunks are done, so a run that was
    stopped goes on with the next.  ``answers`` reads the result."""
    return questions.writeStream.foreachBatch(lambda df, n: answer_chunk(df, n, answer, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, out: str, key: str = "quid") -> DataFrame:
    """All answers, of a question that came in several chunks the first."""
    rows = spark.read.parquet(out)
    kept = [c for c in rows.columns if c not in (key, "chunk")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*kept), "chunk").alias("x")).select(key, "x.*")
