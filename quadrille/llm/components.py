"""Connected components by repeated contraction, on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, discard

MAX_ROUNDS = 200
#: A contracted graph of at most so many links is finished by one task.
LAST_LINKS = 1 << 14


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, p): each end of the few links left and the smallest id it reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], ["v", "p"])


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Each round gives every vertex its smallest neighbour (or itself) and relabels the links
    with it; links inside a label vanish.  Stars end after one or two rounds, a path after
    a logarithmic number.  A hub is pre-aggregated by ``min`` before its rows are shuffled.
    Once at most ``LAST_LINKS`` links are left, one task joins their ends.  Nothing is
    collected but one count a round.  Nulls and self links are dropped.
    """
    used = []
    edges = checkpointed(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(MAX_ROUNDS):
        left = edges.count()
        if not left:
            break
        last = left <= LAST_LINKS
        if last:
            near = edges.coalesce(1).mapInArrow(_finish, "v long, p long")
        else:
            ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
            near = edges.select(ends.alias("x")).groupBy("x.v").agg(F.min("x.u").alias("u")).select("v", F.least("v", "u").alias("p"))
        near = checkpointed(near)
        used += [edges, near]
        moved = near.select(F.col("v").alias("component"), F.col("p").alias("to"))
        labels = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        if last:
            break
        edges = checkpointed(
            edges.join(near.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(near.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = checkpointed(labels)
    discard(edges, *used)
    return out
