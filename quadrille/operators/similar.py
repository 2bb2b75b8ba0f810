"""String similarity joins: pairs of names that are close, without comparing all pairs.

Two names that are close share most of their grams (runs of q letters).  If at most ``lost`` grams of a name can be missing in a
close one, then among the ``lost + 1`` rarest grams of each there is a common one (prefix filter): names meet in an equi-join on
these alone, and rare grams name few partners.  For a name with no more grams than that the filter says nothing; such names
are left out here, and the caller compares them otherwise.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(name: str, q: int) -> Column:
    """The name's runs of q letters, each numbered by how often it came before."""
    runs = F.transform(F.sequence(F.lit(1), F.length(name) - q + 1), lambda i: F.substring(F.col(name), i, F.lit(q)))
    return F.aggregate(
        F.when(F.length(name) >= q, runs).otherwise(F.array().cast("array<string>")),
        F.array().cast("array<struct<g:string,k:int>>"),
        lambda done, g: F.concat(done, F.array(F.struct(g.alias("g"), F.size(F.filter(done, lambda d: d["g"] == g)).alias("k")))),
    )


def candidate_pairs(names: DataFrame, entities: DataFrame, lost: Column, gap: Column, q: int = 2) -> DataFrame:
    """(name, entity): the pairs that can be close, of names with more than ``lost`` grams; both tables have a column name, of
    different values.

    ``lost``: grams of a name (columns name, n its length) that a close one may lack; ``gap``: by how much the length of a
    close one may differ.  The grams of a name stand in order of how many dictionary names have them."""

    def tokens(df: DataFrame) -> DataFrame:
        return df.select("name", F.length("name").alias("n"), F.explode(_grams("name", q)).alias("x")).select("name", "n", "x.*")

    known = tokens(entities)
    often = known.groupBy("g", "k").agg(F.count(F.lit(1)).alias("often"))

    def rarest(df: DataFrame, as_: str) -> DataFrame:
        counted = df.join(often, ["g", "k"], "left").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", "k"))).alias("all"))
        first = F.slice("all", F.lit(1), lost.cast("int") + 1)
        return counted.select(F.col("name").alias(as_), F.col("n").alias(f"{as_}_n"), gap.alias(f"{as_}_gap"), (F.size("all") > lost).alias(f"{as_}_long"), F.explode(first).alias("x")).select("*", "x.g", "x.k").drop("x")

    met = rarest(tokens(names), "asked").where("asked_long").join(rarest(known, "entity"), ["g", "k"])
    near = F.abs(F.col("asked_n") - F.col("entity_n")) <= F.greatest("asked_gap", "entity_gap")
    return met.where(near).select(F.col("asked").alias("name"), "entity").distinct()


def deletion_forms(name: Column, most: int) -> Column:
    """The name and all that is left of it without up to ``most`` of its letters."""

    def less(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), x.substr(i + 1, F.length(x))))

    forms = every = F.array(name)
    for _ in range(most):
        forms = F.array_distinct(F.flatten(F.transform(forms, less)))
        every = F.array_union(every, forms)
    return every


def pairs_by_deletion(names: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(name, entity): the pairs that have a form in common, among them all of edit distance up to ``most``.

    A name of n letters has about n ** most / most forms, and all but close names have none in common, whatever the dictionary
    looks like."""
    forms = [df.select(F.col("name").alias(as_), F.explode(deletion_forms(F.col("name"), most)).alias("form")) for df, as_ in ((names, "name"), (entities, "entity"))]
    return forms[0].join(forms[1], "form").select("name", "entity").distinct()


def within_distance(names: DataFrame, entities: DataFrame, most: int, q: int = 2) -> DataFrame:
    """(name, entity, distance): exactly the pairs of edit distance up to ``most``, of names with more than q * ``most`` grams (an
    edit touches q at most)."""
    return _near(candidate_pairs(names, entities, F.lit(q * most), F.lit(most), q), most)


def _near(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.withColumn("distance", F.levenshtein("name", "entity", most)).where("distance >= 0")


def within_two(names: DataFrame, entities: DataFrame, longest: int = 30) -> DataFrame:
    """(name, entity, distance): exactly the pairs of edit distance up to 2.

    Names of up to ``longest`` letters meet by their forms, longer ones, which have many forms but also many grams, by grams."""
    short, length = names.where(F.length("name") <= longest), F.length("name")
    few = _near(pairs_by_deletion(short, entities.where(length <= longest + 2), 2), 2)
    return few.unionAll(within_distance(names.where(length > longest), entities.where(length > longest - 2), 2, 3))


def within_ratio(names: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """(name, entity, ratio): exactly the pairs whose difflib ratio is at least ``least``, of names that the filter can tell.

    There are at most u + 1 blocks that match, u being the unmatched letters of both, (1 - ratio) of both lengths, so of a name
    of n letters at most n - m + u letter pairs are missing, m being the letters that match."""
    n = F.col("n")
    lost = F.floor(n * (2 * (1 - least) / least + (2 - 2 * least) / (2 - least)) + 1e-9)
    gap = F.floor(n * (2 - 2 * least) / least + 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = difflib.SequenceMatcher()
        for b in batches:
            ratio, last = [], None
            for name, entity in zip(b["name"], b["entity"], strict=True):
                if name != last:
                    match.set_seq2(name)
                    last = name
                match.set_seq1(entity)
                ratio.append(match.ratio() if match.quick_ratio() >= least else 0.0)
            yield b.assign(ratio=ratio)[lambda x: x["ratio"] >= least]

    return candidate_pairs(names, entities, lost, gap).sortWithinPartitions("name").mapInPandas(run, "name string, entity string, ratio double")


def ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` (name, entity) with their difflib ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = difflib.SequenceMatcher()
        for b in batches:
            ratio, last = [], None
            for name, entity in zip(b["name"], b["entity"], strict=True):
                if name != last:
                    match.set_seq2(name)
                    last = name
                match.set_seq1(entity)
                ratio.append(match.ratio())
            yield b.assign(ratio=ratio)

    return pairs.sortWithinPartitions("name").mapInPandas(run, "name string, entity string, ratio double")


class Listed:
    """A block of texts, to which a name is compared letter by letter in all texts at once; a name's letters are the bits of a
    word, of 64 bits or, for longer names, of Python's integers."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], int)
        alphabet = {c: i for i, c in enumerate(sorted(set().union(*texts)), 1)}
        self.alphabet, self.letters = alphabet, np.zeros((self.size.max(initial=0), len(texts)), int)
        for i, t in enumerate(texts):
            self.letters[: len(t), i] = [alphabet[c] for c in t]

    def _bits(self, name: str) -> tuple[np.ndarray, type]:
        """The places of each letter of the alphabet in the name; none for the end of a text."""
        places = [0] * (len(self.alphabet) + 1)
        for i, c in enumerate(name):
            if c in self.alphabet:
                places[self.alphabet[c]] |= 1 << i
        word = np.uint64 if len(name) <= 64 else int
        return np.array(places, np.uint64 if word is np.uint64 else object), word

    def common(self, name: str) -> np.ndarray:
        """The length of the longest common subsequence with each text."""
        places, word = self._bits(name)
        full = word((1 << len(name)) - 1)
        rest = np.full(len(self.size), full, places.dtype)
        for row in self.letters:
            met = rest & places[row]
            rest = ((rest + met) | (rest - met)) & full
        return len(name) - np.array([x.bit_count() for x in rest.tolist()], int)

    def distances(self, name: str) -> np.ndarray:
        """The edit distance to each text."""
        if not name:
            return self.size.copy()
        places, word = self._bits(name)
        full, one, top = word((1 << len(name)) - 1), word(1), word(len(name) - 1)
        up, down, out = np.full(len(self.size), full, places.dtype), np.zeros(len(self.size), places.dtype), np.full(len(self.size), len(name), int)
        for j, row in enumerate(self.letters):
            same = places[row]
            across = (((same & up) + up) ^ up) | same
            more, less = (down | (full ^ ((across | up) & full))), up & across
            step = ((more >> top) & one).astype(int) - ((less >> top) & one).astype(int)
            out += np.where(j < self.size, step, 0)
            more, less = ((more << one) | one) & full, (less << one) & full
            flat = same | down
            up, down = less | (full ^ ((flat | more) & full)), more & flat
        return out


#: Pairs of a name and a prefix that are looked at at once.
STEP = 1 << 16


class Prefixes:
    """A block of texts, all different and sorted, as the tree of their prefixes.  A search carries, for each pair of a name and a
    prefix, the distances of the prefix to the name's prefixes of about its length, and goes on to longer prefixes only while one
    of these is small enough: texts that begin alike are compared once."""

    def __init__(self, texts: list[str]):
        self.size, self.at, self.letters = _flat(texts)
        common = np.full(len(texts), -1)  # letters that a text shares with the one before
        alike, depth = np.arange(1, len(texts)), 0
        while len(alike):
            common[alike] = depth
            alike = alike[(self.size[alike] > depth) & (self.size[alike - 1] > depth)]
            alike = alike[self.letters[self.at[alike] + depth] == self.letters[self.at[alike - 1] + depth]]
            depth += 1
        self.first: list[np.ndarray] = []  # by length of the prefix: the first text of each
        rows = np.arange(len(texts))
        while len(rows):
            self.first.append(rows[common[rows] < len(self.first)])
            rows = rows[self.size[rows] >= len(self.first)]
        self.longer = [np.append(np.searchsorted(b, a), len(b)) for a, b in pairwise([*self.first, np.zeros(0, int)])]

    def near(self, names: list[str], most: int, change: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, text, distance), as places in their lists: all pairs of distance up to ``most``, where a letter changed counts
        ``change``: 1, as in the edit distance, or 2, where only letters left out or added count."""
        size, at, letters = _flat(names)
        width, far, out = 2 * most + 1, most + 1, [np.zeros((3, 0), int)]
        off = np.arange(width)[:, None] - most  # a row's place in the name, from the length of the prefix
        start = np.where((off >= 0) & (off <= size), off, far).astype(np.int8)
        todo = [(0, np.arange(len(names)), np.zeros(len(names), int), start)] if names and self.first else []
        while todo:
            depth, name, node, row = todo.pop()
            count = self.longer[depth][node + 1] - self.longer[depth][node]
            n = max(1, int(np.searchsorted(np.cumsum(count), STEP, "right")))
            if n < len(name):
                todo.append((depth, name[n:], node[n:], row[:, n:]))
                name, node, row, count = name[:n], node[:n], row[:, :n], count[:n]
            text, end = self.first[depth][node], size[name] - depth + most
            whole = np.flatnonzero((self.size[text] == depth) & (end >= 0) & (end < width))
            whole = whole[row[end[whole], whole] <= most]
            out.append(np.stack([name[whole], text[whole], row[end[whole], whole]]))
            if not count.any():
                continue
            place = depth + off
            inside = (place >= 0) & (place < size[name])
            seen = np.where(inside, letters[np.where(inside, at[name] + place, 0)] if len(letters) else 0, 0)
            over = place >= size[name]
            of = np.repeat(np.arange(len(name)), count)
            child = np.arange(len(of)) + np.repeat(self.longer[depth][node] - np.cumsum(count) + count, count)
            letter = self.letters[self.at[self.first[depth + 1][child]] + depth]
            new = np.full((width, len(of)), far, np.int8)
            for t in range(width):
                best = row[t, of] + np.where(seen[t, of] == letter, 0, change).astype(np.int8)
                if t + 1 < width:
                    best = np.minimum(best, row[t + 1, of] + 1)
                if t:
                    best = np.minimum(best, new[t - 1] + 1)
                new[t] = np.where(over[t, of], far, np.minimum(best, far))
            kept = np.flatnonzero(new.min(axis=0) <= most)
            if len(kept):
                todo.append((depth + 1, name[of[kept]], child[kept], new[:, kept]))
        return tuple(np.concatenate(out, axis=1))


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of texts, where each begins, and the letters of all."""
    size = np.array([len(t) for t in texts], int)
    return size, np.cumsum(size) - size, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
