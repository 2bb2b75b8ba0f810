"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) with ``docs`` all that the stage before kept; ``run``
writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.language import UNDETERMINED, held_out, train_languages, with_language
from quadrille.llm.leaks import without_leaks
from quadrille.llm.mixing import mixed_rows
from quadrille.llm.neardup import one_of_each
from quadrille.llm.session import checkpointed, read_table
from quadrille.llm.sharding import shard_documents

#: A text in which no language has this share of the letters is rejected, as is one without letters.
LEAST_LANGUAGE_SHARE = 0.3
SHARDS = 40
SEED = 42


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a determined language; a null text or one without letters goes."""
    model = train_languages(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    named = with_language(docs, model)
    pred, score = named.columns[-2:]
    return named.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that with the smallest id; each row is judged by its own text, also
    where ids repeat or are missing."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text repeats a benchmark item, whatever their ids."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: a source below its target repeats, up to 3 times; a text without words goes."""
    return mixed_rows(docs, seed=SEED)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row, by its doc_id; rows without one share a shard."""
    return shard_documents(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained language scores, minwise trees and fitting by programme cannot be stated in SQL.
ORACLE_SQL = None
