"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



WINDOW = 3


def _windows(lines: Column, window: int) -> Column:
    """(pos, h1, h2) of each run of ``window`` lines that are not all blank."""
    starts = F.when(F.size(lines) >= window, F.sequence(F.lit(0), F.size(lines) - window)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        run = F.slice(lines, i + 1, window)
        return F.struct(i.alias("pos"), F.xxhash64(F.lit(1), run).alias("h1"), F.xxhash64(F.lit(2), run).alias("h2"), F.exists(run, lambda x: F.length(F.trim(x)) > 0).alias("full"))

    return F.filter(F.transform(starts, one), lambda w: w["full"])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, pos) of windows that occur earlier, in order of doc_id, text hash and position.

    Windows are told apart by 128 bits of hash.  A frequent window is counted before it is
    shuffled, and the join back on it can be split, so no task gathers its occurrences."""
    lines = docs.select("doc_id", "th", F.split("text", "\n", -1).alias("lines"))
    rows = lines.select("doc_id", "th", F.explode(_windows(F.col("lines"), window)).alias("w")).select("doc_id", "th", "w.pos", "w.h1", "w.h2")
    firsts = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first")).where("n > 1").drop("n")
    later = rows.join(firsts, ["h1", "h2"]).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return later.select("doc_id", "th", "pos")


def _strip(batches, window: int):
    for batch in batches:
        texts, starts = batch.column("text").to_pylist(), batch.column("starts").to_pylist()
        kept, total, removed = [], [], []
        for text, pos in zip(texts, starts, strict=True):
            lines = text.split("\n") if text is not None else []
            covered = bytearray(len(lines))
            for p in pos or ():
                covered[p : p + window] = b"\1" * window
            kept.append(text if not pos else "\n".join(x for x, c in zip(lines, covered, strict=True) if not c))
            total.append(len(lines))
            removed.append(sum(covered))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every row of ``docs`` (doc_id, text).

    Lines end at each newline and are compared as they are.  Every run of ``window`` lines that
    occurred before (in a smaller doc_id, nulls first; in this text further up) is covered; covered
    lines go, once each.  Texts of fewer lines and windows of blank lines stay.  A null text
    stays null with 0 lines; an empty text has one line.  Rows with equal doc_id and text are
    one document.  Other columns are neither read nor returned."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    cover = repeated_windows(base, window).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    d, c = base.alias("d"), cover.alias("c")
    joined = d.join(c, F.expr("d.doc_id <=> c.doc_id and d.th = c.th"), "left").select("d.doc_id", "d.text", "c.starts")
    return joined.mapInArrow(lambda b: _strip(b, window), "doc_id long, text string, n_lines long, n_removed long")
