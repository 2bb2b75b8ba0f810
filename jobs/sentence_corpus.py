"""Makes the sentence corpus that semantic retrieval searches from raw texts.

    python -m jobs.sentence_corpus --documents PATH --conversations PATH --out DIR [--config jobs/sentence_corpus.json]

Documents and conversation turns are cut into sentences; sentences that are the same after answer normalisation (case,
signs, articles, white space) are one, which keeps the first place where it stands, how often it was seen, its words and its
temporal cue.  Output: Parquet by origin and language.  Each run writes the whole corpus anew.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import run
from quadrille.functions.text import cue_in_question, normalise_answer, squeeze

log = logging.getLogger(__name__)

CORPUS = "sentence string, id long, part long, pos int, n_seen long, n_words int, cue string, origin string, lang string"


def sentences_of(text: Column) -> Column:
    """The text's sentences: a line ends one, and so does ``.``, ``!`` or ``?`` before white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n")


def corpus_of(texts: DataFrame, least_words: int) -> DataFrame:
    """The different sentences of (origin, id, part, lang, text).

    Equal ones are gathered by an aggregate with a partial step, so a sentence that stands in a large part of all texts is no hot spot."""
    # Each text is the one element of an array that is exploded: a plain column would be made again wherever the filter or the aggregate names it.
    cut = texts.select("origin", "id", "part", "lang", F.posexplode(sentences_of(F.col("text"))).alias("pos", "raw"))
    found = cut.select("origin", "id", "part", "lang", "pos", F.explode(F.array(squeeze(F.col("raw")))).alias("sentence"))
    found = found.select("*", F.explode(F.array(normalise_answer(F.col("sentence")))).alias("key"))
    keyed = found.withColumn("n_words", F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", " ")))).where(F.col("n_words") >= least_words)
    first = F.min(F.struct("origin", "id", "part", "pos", "sentence", "lang")).alias("x")
    return keyed.groupBy("key", "n_words").agg(first, F.count(F.lit(1)).alias("n_seen")).select(
        "x.sentence", "x.id", "x.part", "x.pos", "n_seen", "n_words", cue_in_question(F.col("x.sentence")).alias("cue"), "x.origin", "x.lang"
    )


def build_sentence_corpus(spark: SparkSession, documents: str, conversations: str, out: str, least_words: int = 2) -> dict:
    """Writes the corpus of ``documents`` (doc_id, text, lang) and ``conversations`` (conv_id, turn, text) to ``out``.

    ``least_words``: shorter sentences are left out.  Null and empty texts have no sentence; repeated rows count as seen again."""
    d, c = spark.read.parquet(documents), spark.read.parquet(conversations)
    texts = d.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("part"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.unionByName(c.select(F.lit("conversations").alias("origin"), F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("part"), F.lit(None).cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    corpus_of(texts, least_words).hint("rebalance", "origin", "lang").write.mode("overwrite").partitionBy("origin", "lang").parquet(out)
    written = read_corpus(spark, out).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_seen"), F.lit(0)).alias("seen")).first()
    done = {"documents": d.count(), "turns": c.count(), "sentences": written.seen, "written": written.n}
    log.info("read %(documents)d documents and %(turns)d turns with %(sentences)d sentences; wrote %(written)d different ones", done)
    return done


def read_corpus(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(out)


if __name__ == "__main__":
    run(build_sentence_corpus, {"documents": "Parquet files of documents", "conversations": "Parquet files of conversation turns", "out": "folder of the corpus"})
