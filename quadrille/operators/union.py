"""Unions whose rows are joined or grouped afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: More partitions than any union has, so that none are put together.
AS_THEY_ARE = 1 << 20


def united(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, by column name.

    The union's partitioning is not taken from its parts: if a part turns out empty
    at run time its number of partitions changes, and a join above the union fails to plan.  A coalesce to more
    partitions than there are changes no partition, but its partitioning is unknown to the planner."""
    for df in others:
        first = first.unionByName(df)
    return first.coalesce(AS_THEY_ARE)
