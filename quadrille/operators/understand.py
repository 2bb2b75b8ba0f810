"""Question understanding: from a question's text to entities, time, subject, relation, object, cue and reference.

With a generator, names and structure come from model replies: names are matched to the dictionary by
meaning or spelling, compared with the dictionary's own hits and, where the two differ, arbitrated.
Without one, dictionary names and simple rules on the places of names and words are the offline default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.models import Generator, generate
from ..functions.temporal import is_date_entity, time_expression
from ..functions.text import cue_in_question, squeeze, strip_fences
from . import ground, vector

# Words of a question that are no part of its relation.
QUESTION_WORDS = "who whom whose which what when where how why did does do has have had was were is are be been will would can could the a an of to by with in on at from for and or it its he she they them his her their time times year years month months day days date country countries person people organization organisation group exactly same first last before after once ever".split()

NAMES_PROMPT = 'List the people, places and organizations that the question names, as a JSON array of texts. No dates.\nQuestion: {question}'
STRUCTURE_PROMPT = 'Give who acts (subject), what is done (relation), to whom (object), the word for time or order (cue) and what it refers to (reference_target), as one JSON object with these five keys; "None" for what is missing.\nQuestion: {question}\nEntities: {entities}'
CHOICE_PROMPT = 'Two lists of entities were found in the question. Reply with the right one as a JSON array of texts.\nQuestion: {question}\nFirst: {left}\nSecond: {right}'


def _filled(template: str, **columns: Column) -> Column:
    parts, rest = [], template
    for name, column in columns.items():
        head, rest = rest.split("{" + name + "}")
        parts += [F.lit(head), F.coalesce(column, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _array_of(raw: Column) -> Column:
    return F.from_json(strip_fences(raw), "array<string>")


def name_mentions(questions: DataFrame, make: Callable[[], Generator], **limits) -> DataFrame:
    """(quid, mentions): the names that a generator finds, squeezed; an unreadable reply is none, dates are none."""
    replies = generate(questions.select("quid", _filled(NAMES_PROMPT, question=F.col("question")).alias("prompt")), make, **limits)
    names = F.transform(F.coalesce(_array_of(F.col("raw")), F.array().cast("array<string>")), squeeze)
    return replies.select("quid", F.filter(names, lambda x: x.isNotNull() & (x != "") & ~is_date_entity(x)).alias("mentions"))


def match_names(names: DataFrame, entities: DataFrame, config: EngineConfig = EngineConfig(), encoder: vector.Encoder | None = None) -> DataFrame:
    """(name, score, semantic, fuzzy): for each different name the dictionary's nearest by meaning, with its
    score, and by spelling."""
    asked = names.select("name").where("name is not null").distinct()
    q = vector.encode_texts(asked.withColumn("quid", F.xxhash64("name")), "name", encoder)
    known = vector.encode_texts(entities.select("name").distinct().withColumn("fact_id", F.xxhash64("name")), "name", encoder)
    hits = vector.top_k(q.select("quid", "vector"), known.select("fact_id", "vector"), 1)
    semantic = hits.join(known.select("fact_id", F.col("name").alias("semantic")), "fact_id").select("quid", "score", "semantic")
    fuzzy = ground.close_matches(asked, entities).withColumnRenamed("entity", "fuzzy")
    return q.select("quid", "name").join(semantic, "quid", "left").join(fuzzy, "name", "left").select("name", "score", "semantic", "fuzzy")


def linked(mentions: DataFrame, matched: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(quid, entities): each question's mentions as dictionary names, in order, without those that have none."""
    chosen = ground.choose_entity(matched, config.entity_threshold).select("name", "entity")
    placed = mentions.select("quid", F.posexplode("mentions").alias("pos", "name")).join(chosen, "name")
    rows = placed.groupBy("quid").agg(F.sort_array(F.collect_list(F.struct("pos", "entity"))).alias("x"))
    return mentions.select("quid").join(rows, "quid", "left").select("quid", F.coalesce(F.array_distinct(F.transform("x", lambda x: x["entity"])), F.array().cast("array<string>")).alias("entities"))


def arbitrated(questions: DataFrame, left: DataFrame, right: DataFrame, make: Callable[[], Generator], **limits) -> tuple[DataFrame, DataFrame]:
    """(entities, errors): ``left`` (quid, entities), questions whose sets differ from ``right``'s as a generator chooses."""
    differ = ground.entity_conflicts(left, right).join(questions.select("quid", "question"), "quid")
    prompt = _filled(CHOICE_PROMPT, question=F.col("question"), left=F.to_json("left_entities"), right=F.to_json("right_entities"))
    verdicts = generate(differ.select("quid", prompt.alias("prompt")), make, **limits).select("quid", _array_of(F.col("raw")).alias("chosen"))
    return ground.apply_arbitration(left, verdicts)


def structure_by_rule(questions: DataFrame, recognised: DataFrame) -> DataFrame:
    """(quid, five fields): the offline default.

    The reference is the first name behind "before" or "after"; the other names are the core.  Of two the first acts; one
    alone acts if a word of the relation follows it or "by" precedes it, else it is acted on.
    The relation is what is left of the question without names, times and common words."""
    q = questions.select("quid", "question", ground._bare_words("question").alias("w")).join(recognised, "quid", "left")
    cue = cue_in_question(F.col("question"))
    spans = F.coalesce("spans", F.array().cast("array<struct<at:int,n:int,entity:string>>"))
    cue_at = F.when(cue.isin("before", "after"), F.array_position("w", cue).cast("int") - 1)
    q = q.withColumn("cue", cue).withColumn("cue_at", cue_at).withColumn("spans", spans)
    q = q.withColumn("ref", F.get(F.filter("spans", lambda x: x["at"] > F.col("cue_at")), F.lit(0)))
    q = q.withColumn("core", F.filter("spans", lambda x: F.col("ref").isNull() | (x["at"] != F.col("ref.at"))))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    common = F.array(*[F.lit(x) for x in QUESTION_WORDS])
    def telling(i: Column) -> Column:
        word = F.get("w", i)
        named = F.exists("spans", lambda x: (i >= x["at"]) & (i < x["at"] + x["n"]))
        return ~named & ~F.array_contains(common, word) & ~is_date_entity(word) & ~word.rlike(r"^\d")

    q = q.withColumn("told", F.when(F.size("w") > 0, F.filter(places, telling)).otherwise(F.array().cast("array<int>")))
    one, two = F.get("core", F.lit(0)), F.get("core", F.lit(1))
    acts = (F.coalesce(F.array_max("told"), F.lit(-1)) > one["at"]) | F.coalesce(F.get("w", one["at"] - 1) == "by", F.lit(False))
    subject = F.when(two.isNotNull() | acts, one["entity"])
    target = F.when(two.isNotNull(), two["entity"]).when(~acts, one["entity"])
    relation = F.nullif(F.array_join(F.transform("told", lambda i: F.get("w", i)), " "), F.lit(""))
    time = time_expression(F.col("question"))
    fields = {"subject": subject, "relation": relation, "object": target, "cue": F.col("cue"), "reference_target": F.coalesce(F.col("ref.entity"), F.when(F.col("cue_at").isNotNull(), time))}
    return q.select("quid", *[F.coalesce(x, F.lit("None")).alias(name) for name, x in fields.items()])


def structure_by_model(questions: DataFrame, entities: DataFrame, make: Callable[[], Generator], **limits) -> DataFrame:
    """(quid, five fields, raw_output) of a generator's replies."""
    q = questions.select("quid", "question").join(entities, "quid", "left")
    prompt = _filled(STRUCTURE_PROMPT, question=F.col("question"), entities=F.to_json(F.coalesce("entities", F.array().cast("array<string>"))))
    return ground.parse_relations(generate(q.select("quid", prompt.alias("prompt")), make, **limits))


def understand(questions: DataFrame, entities: DataFrame, config: EngineConfig = EngineConfig(), make: Callable[[], Generator] | None = None, encoder: vector.Encoder | None = None, **limits) -> dict[str, DataFrame]:
    """Tables by name: entities (quid, entities), relations (quid, five fields), understood (the questions with time,
    entities and the five fields) and, with a generator, mismatches and arbitration_errors.

    Names must be dictionary names (name).  A question without any keeps the text None in all fields that need one."""
    found = ground.recognise(questions, entities)
    tables: dict[str, DataFrame] = {}
    if make is None:
        tables["entities"] = found.select("quid", "entities")
        tables["relations"] = structure_by_rule(questions, found)
    else:
        mentions = name_mentions(questions, make, **limits)
        matched = match_names(mentions.select(F.explode("mentions").alias("name")), entities, config, encoder)
        tables["mismatches"] = ground.mismatches(matched)
        own = linked(mentions, matched, config)
        chosen, tables["arbitration_errors"] = arbitrated(questions, own, found, make, **limits)
        tables["entities"] = chosen.select("quid", "entities")
        tables["relations"] = structure_by_model(questions, tables["entities"], make, **limits)
    kept = [c for c in questions.columns if c not in ("time", "entities")]
    merged = ground.merge_relations(questions.select(*kept), tables["relations"].withColumn("pos", F.lit(0)))
    time = F.array_compact(F.array(time_expression(F.col("question"))))
    none = F.array().cast("array<string>")
    tables["understood"] = merged.join(tables["entities"], "quid", "left").withColumn("entities", F.coalesce("entities", none)).withColumn("time", time)
    return tables
