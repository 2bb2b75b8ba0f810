"""Hit@k evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_answer
from .retrieve import ROUTES


def prediction_list(raw: Column) -> Column:
    """A prediction's text as a list: a JSON list's values, else the text itself; null is no answer."""
    text = F.regexp_replace(raw, r"^\s+", "")
    parsed = F.from_json(text, "array<string>")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(raw))


def hit_at(pred: Column, gold: Column, k: int = 1) -> Column:
    """1 if one of the first ``k`` predictions contains a gold answer after normalising, else 0."""
    p = F.transform(F.slice(F.coalesce(pred, F.array().cast("array<string>")), 1, k), normalise_answer)
    g = F.transform(F.coalesce(gold, F.array().cast("array<string>")), normalise_answer)
    return F.coalesce(F.exists(p, lambda x: F.exists(g, lambda y: x.contains(y))), F.lit(False)).cast("int")


def with_hits(predictions: DataFrame, k: int = 1) -> DataFrame:
    return predictions.withColumn("hit", hit_at(F.col("model_answer"), F.col("ground_truth"), k))


def grouped(predictions: DataFrame, k: int = 1) -> DataFrame:
    """(dimension, value, hit, total): overall and by answer_type, qlabel and (known) qtype, in one pass
    of one grouping-sets aggregate."""
    rows = with_hits(predictions, k).select("answer_type", "qlabel", "qtype", "hit")
    sets = rows.groupingSets([[], ["answer_type"], ["qlabel"], ["qtype"]], "answer_type", "qlabel", "qtype").agg(F.grouping_id().alias("g"), F.sum("hit").alias("hit"), F.count("*").alias("total"))
    dim = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "answer_type").when(F.col("g") == 5, "qlabel").otherwise("qtype")
    value = F.when(F.col("g") == 7, F.lit("all")).when(F.col("g") == 3, F.col("answer_type")).when(F.col("g") == 5, F.col("qlabel")).otherwise(F.col("qtype"))
    return sets.select(dim.alias("dimension"), value.alias("value"), "hit", "total").where((F.col("dimension") != "qtype") | F.col("value").isin(*ROUTES))


def report(predictions: DataFrame, k: int = 1) -> DataFrame:
    """grouped with the percentage to two places."""
    return grouped(predictions, k).withColumn("percent", F.round(100 * F.col("hit") / F.col("total"), 2))


def wrong_cases(predictions: DataFrame, k: int = 1) -> DataFrame:
    return with_hits(predictions, k).where("hit = 0").select("quid", "question", "model_answer", "ground_truth", "qtype", "qlabel", "answer_type", "time_level")
