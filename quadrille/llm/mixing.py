"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met in whole passes over the source plus a part of one more.
That part is fitted on the source's table of lengths: a start gives every length the same
share of its documents, then a bounded-knapsack dynamic programme may change any of these
counts to reach the budget.  Which documents of a length go is drawn by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .session import checkpointed, discard

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Words of room for the first try of the dynamic programme, and for the last.
FIRST_ROOM, LAST_ROOM = 1 << 12, 1 << 25
#: So many different sums at most are listed one by one, however large they are.
LISTED_SUMS = 1 << 16
#: Parts in which the documents of one source and length are counted and cut.
PARTS = 64


def _pieces(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[tuple[int, int]]:
    """(index, copies): binary pieces from which any number of copies up to each count is made."""
    out = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, k = min(count, goal // length), 1
        while left > 0:
            out.append((i, min(k, left)))
            left -= k
            k *= 2
    return out


def _listed(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[int]:
    """The copies whose words sum to the largest sum up to ``goal``, over a list of all sums."""
    pieces, made = _pieces(lengths, counts, goal), {0: -1}
    for j, (i, k) in enumerate(pieces):
        move = k * lengths[i]
        made.update({s + move: j for s in list(made) if s + move <= goal and s + move not in made})
        if goal in made:
            break
    return _traced(pieces, lengths, max(made), made.__getitem__)


def _programme(lengths: Sequence[int], counts: Sequence[int], goal: int) -> list[int]:
    """The same over a row of bits, one for each sum; each sum keeps the piece that first made it."""
    pieces, reached, mask = _pieces(lengths, counts, goal), 1, (1 << (goal + 1)) - 1
    first = np.full(goal + 1, -1, np.int32)
    for j, (i, k) in enumerate(pieces):
        new = reached << (k * lengths[i]) & mask & ~reached
        if new:
            low = (new & -new).bit_length() - 1
            bits = (new >> low).to_bytes((new.bit_length() - low + 7) // 8, "little")
            first[low + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))] = j
            reached |= new
            if reached >> goal & 1:
                break
    return _traced(pieces, lengths, reached.bit_length() - 1, lambda s: int(first[s]))


def _traced(pieces: list[tuple[int, int]], lengths: Sequence[int], total: int, piece_of) -> list[int]:
    take = [0] * len(lengths)
    while total:
        i, k = pieces[piece_of(total)]
        take[i] += k
        total -= k * lengths[i]
    return take


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words sum to ``budget`` or, where no
    subset does, to the largest sum below it; zero lengths are never taken.

    A start p gives each length its share and fills up longest first; it misses the budget by less than the
    longest length w (all in units of the lengths' common divisor).  A best subset z differs from it in
    at most 2w documents: put the documents of z - p and p - z in a row so that after a sum above 0 one of p - z follows and
    else one of z - p; all sums on the way lie in a range of 2w values, so of more documents some run
    would sum to 0 and could be left out.  The programme therefore frees up to 2w documents a length, in growing
    rooms with the shortest first, and ends at the first room that meets the budget exactly or frees all of these.

    So the result is a best one whenever the programme ends by itself: always for at most ``LAST_ROOM``
    words in all, or at most ``LISTED_SUMS`` different sums, and with more words whenever the budget is met.  Only a larger
    source in which no subset that frees ``LAST_ROOM`` words meets the budget may have a better one elsewhere; it misses
    the budget by less than w."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return [c if n else 0 for n, c in zip(lengths, counts, strict=True)]
    live = sorted((i for i, (n, c) in enumerate(zip(lengths, counts, strict=True)) if n and c), key=lambda i: lengths[i])
    unit = gcd(*(lengths[i] for i in live))
    size, have, goal = [lengths[i] // unit for i in live], [counts[i] for i in live], budget // unit
    out = [0] * len(lengths)
    sums = 1
    for c in have:
        sums *= c + 1
        if sums > LISTED_SUMS:
            break
    if sums <= LISTED_SUMS:
        best = _listed(size, have, goal)
    else:
        best = [c * budget // total for c in have]
        rest = goal - sum(n * t for n, t in zip(size, best, strict=True))
        for i in reversed(range(len(size))):
            k = min(have[i] - best[i], rest // size[i])
            best[i], rest = best[i] + k, rest - k * size[i]
        start, most, room = list(best), 2 * size[-1], FIRST_ROOM
        while rest:
            freed, need = [], rest
            for n, t in zip(size, start, strict=True):
                freed.append(min(t, most, max(0, room - need) // n))
                need += freed[-1] * n
            open_ = [f + min(c - t, most) for f, c, t in zip(freed, have, start, strict=True)]
            got = _programme(size, open_, need)
            if sum(n * k for n, k in zip(size, got, strict=True)) > need - rest:
                best = [t - f + k for t, f, k in zip(start, freed, got, strict=True)]
            if sum(n * k for n, k in zip(size, best, strict=True)) == goal or all(f == min(t, most) for f, t in zip(freed, start, strict=True)) or room >= LAST_ROOM:
                break
            room = min(LAST_ROOM, room * 16)
    for i, k in zip(live, best, strict=True):
        out[i] = k
    return out


def running(rows: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """``rows`` with place (from 1, by ``order``) and, for each column of ``sums``, before_<column>: the sum over
    the rows before.  Rows are dealt by ranges of the order and summed in two steps, so no task
    has them all."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = dealt.groupBy("range").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    up = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = own.select("range", F.coalesce(F.sum("n_").over(up), F.lit(0)).alias("n_"), *[F.coalesce(F.sum(f"all_{c}").over(up), F.lit(0)).alias(f"all_{c}") for c in sums])
    w = W.partitionBy("range").orderBy(*order)
    up = w.rowsBetween(W.unboundedPreceding, -1)
    local = dealt.select("*", F.row_number().over(w).alias("place"), *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"before_{c}") for c in sums])
    met = local.join(starts, "range")
    return met.select(*rows.columns, (F.col("place") + F.col("n_")).alias("place"), *[(F.col(f"before_{c}") + F.col(f"all_{c}")).alias(f"before_{c}") for c in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(ix, source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes; a target stops at ``max_repeats`` times its source's size and what is above
    is shared again.  That is the level L with sum(min(weight * L, cap)) = sum of sizes:
    with sources by cap / weight, the first at which what the earlier caps leave, by the
    weight left, is within its own cap."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = running(total, [F.col("source").isNull(), F.col("source")], []).withColumnRenamed("place", "ix")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("ix") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats))
    whole, weights_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = running(ranked, [F.col("cap") / F.col("weight"), F.col("ix")], ["cap", "weight"])
    share = (F.lit(whole) - F.col("before_cap")) / (F.lit(weights_sum) - F.col("before_weight"))
    fits = F.when(share * F.col("weight") <= F.col("cap"), F.struct(F.col("place"), share.alias("share")))
    found = level.agg(F.min(fits)["share"]).first()[0]
    target = F.least(F.col("weight") * F.lit(float("inf") if found is None else float(found)), F.col("cap").cast("double"))
    return ranked.select("ix", "source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    * size: words of the text; a null, empty or wordless text has size 0 and taken 0;
    * taken: words the mix takes from the row, a multiple of its size, at most
      ``max_repeats`` times it; the sum over a source is its rounded target or, if no
      subset of documents gives that, the nearest sum that fitting finds below;
    * rows are drawn by a hash of seed, doc_id and text, so rows without doc_id are drawn each by its
      text; of equal rows so many as are needed are taken, no matter which.

    A hot source costs no task more than its share: documents are counted by source,
    length and hash part first (words are counted once and written), a source is fitted on its table of lengths
    alone, and rows meet their plan, and are ranked, by source, length and part."""
    marked, times = mix_marks(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")), weights, max_repeats, seed, carry=False)
    return marked.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it."""
    marked, times = mix_marks(docs, weights, max_repeats, seed)
    return marked.select(F.explode(F.array_repeat("row", times.cast("int"))).alias("row")).select("row.*")


def mix_marks(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 42, carry: bool = True) -> tuple[DataFrame, Column]:
    """Rows with their plan, and how often the mix takes each: with ``carry`` all columns of ``docs``, packed in
    ``row``, else doc_id, source, size and the plan's source_size and target."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    text = F.xxhash64(F.col("text").cast("string"))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col("doc_id").alias("row")
    source = F.col("source").cast("string")
    rows = docs.select(kept, source.alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("draw"), F.xxhash64("doc_id", text, F.lit(seed + 1)).alias("tie"))
    rows = rows.withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int")).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    if not carry:  # words are counted once; whole rows are rather counted twice than written
        rows = checkpointed(rows)
    counted = checkpointed(rows.groupBy("source", "sk", "size", "part").agg(F.count("*").alias("n")))
    table = counted.groupBy("source", "sk", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(table.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_repeats)
    targets = targets.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = int(pdf["source_size"].iloc[0])
        goal = min(round(float(pdf["target"].iloc[0])), max_repeats * whole)
        passes, budget = divmod(goal, whole) if whole else (0, 0)
        pdf = pdf.sort_values("size")
        lengths, counts = [int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]]
        out = pdf[["sk", "size", "source_size", "target"]].copy()
        out["passes"], out["more"] = passes, fit_lengths(lengths, counts, budget)
        return out

    fitted = table.join(targets, "sk").select("sk", "size", "n", "source_size", "target").groupBy("sk").applyInPandas(fit, "sk string, size long, source_size long, target double, passes long, more long")
    upto = F.sum("n").over(W.partitionBy("sk", "size").orderBy("part"))
    parts = counted.select("sk", "size", "part", "n", (upto - F.col("n")).alias("before")).join(fitted, ["sk", "size"])
    plan = checkpointed(parts.select("sk", "size", "part", "source_size", "target", "passes", F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before"))).alias("extra")))
    discard(counted)
    # A source and length are met in PARTS pieces; texts of no words need no rank.
    met = rows.join(plan, ["sk", "size", "part"])
    place = F.row_number().over(W.partitionBy("sk", "size", "part").orderBy("draw", "tie"))
    ranked = met.where("size > 0").withColumn("place", place).unionByName(met.where("size = 0").withColumn("place", F.lit(1)))
    times = F.when(F.col("size") > 0, F.col("passes") + (F.col("place") <= F.col("extra")).cast("long")).otherwise(0)
    return (ranked if carry else ranked.withColumnRenamed("row", "doc_id")), times
