"""Helpers on the Spark session: tables, checkpoints, schema-safe column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard
from ..sources.scratch import stored as checkpointed

__all__ = ["checkpointed", "discard", "free_name", "read_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
