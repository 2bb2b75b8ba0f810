"""Question understanding: entities, relations, arbitration, merging of their results."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.temporal import is_date_entity
from ..functions.text import strip_fences
from ..sources.scratch import stored
from .similar import Listed, Prefixes
from .union import united


def _bare_words(text: str) -> Column:
    """The words of a text in lower case; signs between and around words are spaces."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[\s?!.,;:\"]+", " ")), " "), lambda w: w != "")


def dictionary_entities(questions: DataFrame, entities: DataFrame, longest: int | None = None) -> DataFrame:
    """(quid, entity): the longest dictionary name (ties: the first by code point) that stands in the
    question as whole words.

    Runs of as many words as dictionary names have (at most ``longest``, if given) meet the
    dictionary in an equi-join on lower-cased text without signs.  Names are numbered in the order in which they win, so of
    the hits only one number a question is kept."""
    ahead = [-F.length("name"), F.col("name")]
    ranked = entities.select("name").distinct().repartitionByRange(*ahead).sortWithinPartitions(*ahead).withColumn("rank", F.monotonically_increasing_id())
    names = stored(ranked.select(F.array_join(_bare_words("name"), " ").alias("key"), F.size(_bare_words("name")).alias("n"), F.col("name").alias("entity"), "rank").where("n > 0"))
    lengths = sorted(r.n for r in names.select("n").distinct().collect() if longest is None or r.n <= longest)
    q = questions.where("quid is not null").select("quid", _bare_words("question").alias("w"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("w"))
    runs = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))
    hits = q.select("quid", F.explode(runs).alias("key")).join(names.select("key", "rank"), "key")
    return hits.groupBy("quid").agg(F.min("rank").alias("rank")).join(names.select("rank", "entity"), "rank").select("quid", "entity")


def recognise(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(quid, entities, spans): all dictionary names that stand in the question as whole words and are no dates, longest
    first and without overlap, in order of their place; spans: first word (at), words (n) and name of each."""
    key = F.array_join(_bare_words("name"), " ")
    names = entities.select(key.alias("key"), F.size(_bare_words("name")).alias("n"), F.col("name").alias("entity")).where("n > 0").where(~is_date_entity(F.col("name")))
    names = names.groupBy("key", "n").agg(F.min("entity").alias("entity"))
    lengths = sorted(r.n for r in names.select("n").distinct().collect())
    q = questions.select("quid", _bare_words("question").alias("w"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("w"))
    runs = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("key")))))
    hits = q.select("quid", F.explode(runs).alias("x")).select("quid", "x.*").join(names, "key")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("size"), "at", "n", "entity")))
    none = F.array().cast("array<struct<size:int,at:int,n:int,entity:string>>")

    def free(kept: Column, x: Column) -> Column:
        return ~F.exists(kept, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"]))

    kept = F.aggregate(F.col("hits"), none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    placed = hits.groupBy("quid").agg(ranked.alias("hits")).select("quid", F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["entity"].alias("entity")))).alias("found"))
    return placed.select("quid", F.transform("found", lambda x: x["entity"]).alias("entities"), F.col("found").alias("spans"))


def _blocks(names: DataFrame, entities: DataFrame, nn: int, ne: int) -> tuple[DataFrame, DataFrame]:
    """Names (nb, name) and dictionary names (eb, name) of ``nn`` and ``ne`` blocks, each as often as every block of one meets every
    block of the other."""
    a = names.select("name", "nb", F.explode(F.sequence(F.lit(0), F.lit(ne - 1))).alias("eb"))
    b = entities.select("name", "eb", F.explode(F.sequence(F.lit(0), F.lit(nn - 1))).alias("nb"))
    return a, b


def _dealt(names: DataFrame, rows: int, block: str) -> tuple[DataFrame, int]:
    """``names`` with their block by hash, of about ``rows`` names, and the number of blocks."""
    n = max(1, -(-names.count() // rows))
    return names.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias(block)), n


#: Levels of unmatched letters that names meet the dictionary's prefixes at; those that are further off meet it in blocks.
LEVELS = (1, 2, 3, 4)


def _by_levels(asked: DataFrame, known: DataFrame, tree_names: int, tree_rows: int, run, schema: str, best: Column, settled: Callable[[int], Column]) -> tuple[DataFrame, DataFrame]:
    """The rows of names that are settled at one of ``LEVELS``, and the other names.

    ``run(level)`` compares a block of names with one of dictionary names that are neighbours in order, so that a block is a
    tree of few prefixes; ``best`` of a name's rows is x, and ``settled(level)`` tells whether that stands.  A level looks only at
    names that all levels before left."""
    ne = max(1, -(-known.count() // tree_rows))
    ranges = stored(known.repartitionByRange(ne, "name").select("name", F.spark_partition_id().alias("eb")))
    done, rest = [], stored(asked)
    for level in LEVELS:
        if done and rest.isEmpty():
            break
        left, nn = _dealt(rest, tree_names, "nb")
        found = _in_blocks(left, ranges, nn, ne, run(level), schema).groupBy("name").agg(best.alias("x"))
        found = stored(found.where(settled(level)))
        done.append(found)
        rest = stored(rest.join(found, "name", "left_anti"))
    return united(*done), rest


def nearest_by_levenshtein(names: DataFrame, entities: DataFrame, name_rows: int = 1024, entity_rows: int = 4096, tree_names: int = 65_536, tree_rows: int = 262_144) -> DataFrame:
    """(name, entity, distance): the dictionary name with the least edit distance, ties by code point.

    Names at distance 1, then 2 and so on, are found in the tree of the dictionary's prefixes (``similar.Prefixes``), in blocks of
    about ``tree_names`` and ``tree_rows``; how far names are apart bounds the prefixes that they meet, also where many share most of
    their letters.  Names that are further off than the last level meet the dictionary in blocks of about ``name_rows`` and ``entity_rows`` names."""
    asked = names.select("name").where("name is not null").distinct()
    known = stored(entities.select("name").where("name is not null").distinct())

    def level(most: int):
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            listed, left = sorted(b["name"]), a["name"].tolist()
            name, text, distance = Prefixes(listed).near(left, most)
            order = np.lexsort((text, distance, name))
            order = order[np.diff(name[order], prepend=-1) > 0]
            rows = [(left[i], listed[j], n) for i, j, n in zip(name[order], text[order], distance[order].tolist(), strict=True)]
            return pd.DataFrame(rows, columns=["name", "entity", "distance"])

        return run

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(b["name"])
        block, rows = Listed(listed), []
        for name in a["name"] if listed else ():
            distance = block.distances(name)
            i = int(np.argmin(distance))
            rows.append((name, listed[i], int(distance[i])))
        return pd.DataFrame(rows, columns=["name", "entity", "distance"])

    schema, best = "name string, entity string, distance int", F.min(F.struct("distance", "entity"))
    close, rest = _by_levels(asked, known, tree_names, tree_rows, level, schema, best, lambda most: F.lit(True))
    (a, nn), (b, ne) = _dealt(rest, name_rows, "nb"), _dealt(known, entity_rows, "eb")
    far = _in_blocks(a, b, nn, ne, run, schema).groupBy("name").agg(best.alias("x"))
    return united(close, far).select("name", "x.entity", "x.distance")


def _in_blocks(names: DataFrame, entities: DataFrame, nn: int, ne: int, run, schema: str) -> DataFrame:
    """``run`` on every block of names with every block of dictionary names; the pairs of blocks are dealt over all tasks."""
    parts, keys = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["nb", "eb"]
    left, right = (df.repartition(parts, *keys).groupBy(*keys) for df in _blocks(names, entities, nn, ne))
    return left.cogroup(right).applyInPandas(run, schema)


def close_matches(names: DataFrame, entities: DataFrame, cutoff: float = 0.6, name_rows: int = 1024, entity_rows: int = 4096, tree_names: int = 65_536, tree_rows: int = 262_144) -> DataFrame:
    """(name, entity): the dictionary name with the largest difflib ratio of at least ``cutoff`` (ties: the last by code
    point), else null.

    The letters that match are a common subsequence, so a pair with u unmatched letters of n + m has at most the ratio
    1 - u / (n + m).  Pairs with u up to 1, then 2 and so on, are found in the tree of the dictionary's prefixes, as in
    ``nearest_by_levenshtein``; a name of n letters is settled at u if its best ratio is above 1 - (u + 1) / (2 n + u + 1), the most that
    others can have.  Blocks of the others meet blocks of the dictionary, which may have any size; there the longest common
    subsequence bounds the ratio, and only pairs whose bound is not below the best ratio so far are compared."""
    asked = names.select("name").where("name is not null").distinct()
    known = stored(entities.select("name").where("name is not null").distinct())

    def level(most: int):
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            listed, left, rows = sorted(b["name"]), a["name"].tolist(), {}
            name, text, _ = Prefixes(listed).near(left, most, 2)
            match, last = difflib.SequenceMatcher(), -1
            for i, j in sorted(zip(name.tolist(), text.tolist(), strict=True)):
                if i != last:
                    match.set_seq2(left[i])
                    last = i
                match.set_seq1(listed[j])
                rows[i] = max(rows.get(i, (-1.0, "")), (match.ratio(), listed[j]))
            return pd.DataFrame([(left[i], *x) for i, x in rows.items()], columns=["name", "ratio", "entity"])

        return run

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(b["name"])
        block, rows = Listed(listed), []
        for name in a["name"] if listed else ():
            bound = 2 * block.common(name) / (block.size + len(name))
            best, match = (cutoff, ""), difflib.SequenceMatcher()
            match.set_seq2(name)
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < best[0]:
                    break
                match.set_seq1(listed[i])
                best = max(best, (match.ratio(), listed[i]))
            if best[1]:
                rows.append((name, *best))
        return pd.DataFrame(rows, columns=["name", "ratio", "entity"])

    filled, n = asked.where("name <> ''"), F.length("name")
    schema, best = "name string, ratio double, entity string", F.max(F.struct("ratio", "entity"))
    stands = lambda u: (F.col("x.ratio") >= cutoff) & (F.col("x.ratio") > 1 - (u + 1) / (2 * n + u + 1) + 1e-9)
    close, rest = _by_levels(filled, known, tree_names, tree_rows, level, schema, best, stands)
    (a, nn), (b, ne) = _dealt(rest, name_rows, "nb"), _dealt(known, entity_rows, "eb")
    far = _in_blocks(a, b, nn, ne, run, schema).groupBy("name").agg(best.alias("x"))
    return asked.join(united(close, far).select("name", "x.entity"), "name", "left")


def choose_entity(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(…, entity): the semantic match if its score is above the threshold, else the fuzzy one; null goes."""
    return scored.withColumn("entity", F.when(F.col("score") > threshold, F.col("semantic")).otherwise(F.col("fuzzy"))).where("entity is not null")


def mismatches(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("semantic").eqNullSafe(F.col("fuzzy")))


def normal_set(x: str):
    """Lower-cased, trimmed, distinct and sorted, without null and empty values."""
    kept = F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != ""))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda e: F.lower(F.regexp_replace(e, r"^\s+|\s+$", "")))))


def entity_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Questions in both tables (quid, entities) whose entity sets differ."""
    a = left.select("quid", normal_set("entities").alias("left_entities"))
    b = right.select("quid", normal_set("entities").alias("right_entities"))
    return a.join(b, "quid").where("left_entities <> right_entities")


def apply_arbitration(questions: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated, errors): an arbitrated question takes the chosen entities (none if null) and is marked;
    null verdicts are listed as errors, too."""
    v = verdicts.select("quid", "chosen", F.lit(True).alias("seen"))
    joined = questions.drop("arbitration").join(v, "quid", "left")
    chosen = F.when(F.col("seen"), F.coalesce("chosen", F.array().cast("array<string>"))).otherwise(F.col("entities"))
    out = joined.withColumn("entities", chosen).withColumn("arbitration", F.when(F.col("seen"), F.lit("arbitrated"))).drop("chosen", "seen")
    return out, verdicts.where("chosen is null").select("quid")


RELATION_FIELDS = ("subject", "relation", "object", "cue", "reference_target")


def parse_relations(replies: DataFrame) -> DataFrame:
    """(quid, five fields, raw_output) of model replies (quid, raw); an absent field is the text None and
    an unreadable reply keeps its text."""
    schema = "struct<" + ",".join(f"{f}:string" for f in RELATION_FIELDS) + ">"
    got = F.from_json(strip_fences(F.col("raw")), schema)
    read = F.when(F.coalesce(*[got[f] for f in RELATION_FIELDS]).isNotNull(), got)
    parsed = replies.select("quid", "raw", read.alias("x"))
    fields = [F.coalesce(F.col(f"x.{f}"), F.lit("None")).alias(f) for f in RELATION_FIELDS]
    return parsed.select("quid", *fields, F.when(F.col("x").isNull(), F.col("raw")).alias("raw_output"))


def merge_relations(questions: DataFrame, relations: DataFrame, position: str = "pos") -> DataFrame:
    """Questions with the five fields of their last relation row; missing ones are the text None."""
    last = relations.groupBy("quid").agg(F.max_by(F.struct(*RELATION_FIELDS), position).alias("x"))
    kept = [c for c in questions.columns if c not in (*RELATION_FIELDS, "ner_recognized_entities", "semantic_top1_entities", "fuzzy_top1_entities")]
    joined = questions.select(*kept).join(last, "quid", "left")
    return joined.select(*kept, *[F.coalesce(F.col(f"x.{f}"), F.lit("None")).alias(f) for f in RELATION_FIELDS])


def spread(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(quid, cand_rank, rel): questions (quid, relation) with ranked candidates (relation, cand_rank, rel) of
    their relation; each different relation was ranked once."""
    return questions.select("quid", "relation").join(ranked, "relation").select("quid", "cand_rank", "rel")


def rank_in(rows: DataFrame, keys: list[str], by: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key (a window limit that also works before the shuffle)."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)).cast("int")).where(F.col(name) <= k)
