"""Readers and writers: quads, dictionaries, questions, results, resumable output."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import render_sentence
from ..schema import QUESTIONS
from .scratch import stored

ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?$"


def parse_quads(lines: DataFrame, names: str = "space") -> DataFrame:
    """Facts from (line_no, line): subject, relation, object and, perhaps, a time, parted by tabs.

    White space at the line's ends goes first (so a leading tab shifts the columns).  Lines with
    fewer than three columns, an empty subject or object, or a time that is not
    ``yyyy-MM-dd[THH:mm[:ss]]`` are dropped; a third column at the end makes a static fact.
    ``names="space"`` turns underscores into spaces once, here; ``"raw"`` keeps them."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.select("line_no", F.split(text, "\t", -1).alias("c"))

    def name(i: int) -> Column:
        return F.translate(F.get("c", F.lit(i)), "_", " ") if names == "space" else F.get("c", F.lit(i))

    raw = F.get("c", F.lit(3))
    # One template: what a short time lacks of ``yyyy-MM-dd HH:mm:ss`` is filled from its end.
    full = F.concat(F.translate(raw, "T", " "), F.expr("substring(' 00:00:00', length(c[3]) - 9)"))
    stamp = F.when(raw.rlike(ISO_TIME), F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss")))
    out = rows.select(
        "line_no", name(0).alias("s"), name(1).alias("r"), name(2).alias("o"), raw.alias("ts_raw"), stamp.cast("timestamp_ntz").alias("ts"), F.size("c").alias("n")
    ).where("n >= 3 and s <> '' and o <> '' and (ts_raw is null or ts is not null)")
    return out.select("line_no", "s", "r", "o", "ts_raw", "ts", F.col("ts").cast("date").alias("d"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, lines numbered from 1 by file name and place in the file.

    Text is read once, into a table with each line's file, block and place in its task; the blocks' line counts, one row
    a block, say where each begins.  All of it is columns; no task but the one over these counts sees more than its block."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = stored(raw.withColumn("id", F.monotonically_increasing_id()))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return lines.join(starts, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("line_no"), "line")


def read_quads(spark: SparkSession, path: str, names: str = "space") -> DataFrame:
    """Facts of a tab-separated file, lines numbered from 1 in file order."""
    return parse_quads(numbered_lines(spark, path), names)


def sentence_corpus(lines: DataFrame) -> DataFrame:
    """(line_no, fact): ``S R O in T`` of lines with four columns or more; the time is not checked."""
    c = F.split(F.translate(F.regexp_replace("line", r"^\s+|\s+$", ""), "_", " "), "\t", -1)
    rows = lines.select("line_no", c.alias("c")).where(F.size("c") >= 4)
    return rows.select("line_no", F.concat(F.concat_ws(" ", F.slice("c", 1, 3)), F.lit(" in "), F.get("c", F.lit(3))).alias("fact"))


def fact_sentences(facts: DataFrame) -> DataFrame:
    return facts.select("line_no", render_sentence(F.col("s"), F.col("r"), F.col("o"), F.col("d")).alias("fact"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """(name, id) of lines ``name<tab>id``."""
    c = F.split("line", "\t")
    return lines.select(F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).cast("int").alias("id"))


def parse_json_dictionary(texts: DataFrame) -> DataFrame:
    """(name, id) of JSON objects in column ``json``, underscores of names as spaces."""
    pairs = texts.select(F.explode(F.from_json("json", "map<string,int>")).alias("name", "id"))
    return pairs.select(F.translate("name", "_", " ").alias("name"), "id")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".json"):
        return parse_json_dictionary(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    return parse_dictionary(spark.read.text(path).withColumnRenamed("value", "line"))


def read_questions(spark: SparkSession, path: str, schema: T.StructType = QUESTIONS, lines: bool | None = None) -> DataFrame:
    """Questions of a JSON array file (one task a file) or, with ``lines`` or a path that ends so, of JSON lines,
    which are read in blocks; absent fields are null."""
    by_line = path.rstrip("/").endswith((".jsonl", ".ndjson")) if lines is None else lines
    return spark.read.schema(schema).json(path, multiLine=not by_line)


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: the last by ``position``."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), position).alias("row"))
    return newest.select("row.*")


def not_yet_done(todo: DataFrame, done: DataFrame, key: str = "quid") -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``: what a resumed run has left."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def append_results(results: DataFrame, path: str, key: str = "quid") -> int:
    """Appends the rows that ``path`` has not got; returns how many.  Safe to repeat."""
    spark = results.sparkSession
    try:
        left = not_yet_done(results, spark.read.schema(results.schema).parquet(path), key)
    except Exception as e:  # nothing written so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
        left = results
    seen = Observation()
    left.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(seen.get["n"])


def write_results(df: DataFrame, path: str, interchange: bool = False) -> None:
    """Parquet, or JSON lines for interchange."""
    (df.write.mode("overwrite").json if interchange else df.write.mode("overwrite").parquet)(path)


def _versions(spark: SparkSession, path: str) -> tuple[object, list[tuple[int, bool]]]:
    """The file system of ``path`` and the versions there in order, each with whether it is complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(where) if x.isDirectory()] if system.exists(where) else []
    numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return system, [(n, system.exists(hadoop.Path(f"{path}/v{n}/_SUCCESS"))) for n in numbers]


def new_version(spark: SparkSession, path: str) -> str:
    """A folder for the next version of the table ``path``.

    The newest complete version stays, so what was read from it stays readable and a run that dies while it writes
    loses nothing; versions before it, and incomplete ones, are removed."""
    system, versions = _versions(spark, path)
    newest = max((n for n, complete in versions if complete), default=0)
    for n, _ in versions:
        if n != newest:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}"), True)
    return f"{path}/v{max((n for n, _ in versions), default=0) + 1}"


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete version of the table ``path``; ``path`` itself where it has no versions."""
    complete = [n for n, complete in _versions(spark, path)[1] if complete]
    return f"{path}/v{complete[-1]}" if complete else path


def write_json_array(df: DataFrame, path: str, indent: int = 4) -> int:
    """One UTF-8 file with a JSON array of the rows, for tools that read such files; returns the number of rows.

    Rows come to the driver one partition at a time and are not held."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    n = 0
    try:
        for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json")).toLocalIterator():
            text = json.dumps(json.loads(row.json), ensure_ascii=False, indent=indent)
            out.write(bytearray((",\n" if n else "[\n").encode() + text.encode()))
            n += 1
        out.write(bytearray(b"\n]\n" if n else b"[]\n"))
    finally:
        out.close()
    return n


def write_facts(facts: DataFrame, path: str) -> None:
    """The graph, clustered by year so that readers prune by date."""
    facts.withColumn("year", F.year("d")).repartition("year", F.pmod(F.xxhash64("s", "r"), F.lit(16))).sortWithinPartitions("s", "r", "ts").write.mode("overwrite").partitionBy("year").parquet(path)


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A table that is built and written where it is absent."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
