"""Text column functions: normalisation, temporal cues, answer matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue phrases by the cue they stand for.
CUE_PHRASES = {
    "before": ("before", "last before"),
    "after": ("after", "for the first time after"),
    "first": ("first", "for the first time"),
    "last": ("last", "for the last time"),
    "same": (
        "same", "on", "in", "at what time",
        "in the same month as", "in the same month of", "in the same month",
        "on the same day as", "on the same day of", "on the same day",
        "same day as", "same day of", "same day",
        "in the same year as", "in the same year of", "in the same year",
        "on the same year as", "on the same year of",
        "same year as", "same year of", "same year",
        "on the same month as", "on the same month of",
        "same month as", "same month of", "same month",
        "same as", "the same",
        "exact month", "exact month when", "exact month in which",
        "in which month", "in the year of",
    ),
}
CUE_DATE = r"\b(\d{1,2}\s+)?(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b|\bin\s+\d{4}\b|\bon\s+\d{4}\b"
CUES = ("before", "after", "first", "last", "same")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def none_to_null(x: Column) -> Column:
    """The sentinel text None, and empty text, as null."""
    return F.when((x == "None") | (x == ""), F.lit(None)).otherwise(x)


def squeeze(x: Column) -> Column:
    """White space at the ends removed, inside one space."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def cue_of_phrase(raw: Column) -> Column:
    """One of the five cues for a phrase or a date-like text, else null."""
    low = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    out = F.when(low.rlike(CUE_DATE), F.lit("same"))
    for cue, phrases in CUE_PHRASES.items():
        out = F.when(low.isin(*phrases), F.lit(cue)).otherwise(out)
    return F.when((raw == "None") | (raw == ""), F.lit(None)).otherwise(out)


def cue_in_question(question: Column) -> Column:
    """The first of before, after, first, last, same that is a word of the question."""
    out = F.lit(None).cast("string")
    for cue in reversed(CUES):
        out = F.when(F.lower(question).rlike(rf"\b{cue}\b"), F.lit(cue)).otherwise(out)
    return out


def infer_cue(raw: Column, qtype: Column, question: Column) -> Column:
    """The cue phrase, else what the query type means, else a keyword of the question."""
    low, kind = F.lower(question), F.lower(qtype)
    by_type = (
        F.when(kind == "after_first", F.lit("after"))
        .when(kind == "before_last", F.lit("before"))
        .when(kind.isin("equal", "equal_multi"), F.lit("same"))
        .when(kind == "before_after", F.when(low.contains("after"), F.lit("after")).otherwise(F.lit("before")))
        .when(kind == "first_last", F.when(low.contains("first"), F.lit("first")).otherwise(F.lit("last")))
        .otherwise(cue_in_question(question))
    )
    return F.coalesce(cue_of_phrase(raw), by_type)


def question_reference(question: Column) -> Column:
    """The run of words behind the question's first cue word, without ``.``, ``,`` and ``?`` at its ends."""
    out = F.lit(None).cast("string")
    for cue in reversed(CUES):
        # Fixed value: the pattern of a run of capitalised words.
        found = F.regexp_extract(question, rf"(?i){cue}\s+([A-Z][\w().'-]*(?:\s+[A-Z][\w().'-]*)*)", 1)
        out = F.when(F.lower(question).rlike(rf"\b{cue}\b"), found).otherwise(out)
    return F.nullif(F.regexp_replace(F.trim(out), r"^[.,?]+|[.,?]+$", ""), F.lit(""))


def normalise_answer(x: Column) -> Column:
    """Lower case, without ASCII punctuation and the words a, an, the; single spaces."""
    bare = F.translate(F.lower(x), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def answer_matches(pred: Column, gold: Column) -> Column:
    """Whether the normalised gold answer is a part of the normalised prediction."""
    return F.coalesce(normalise_answer(pred).contains(normalise_answer(gold)), F.lit(False))


def strip_fences(x: Column) -> Column:
    """A model reply without Markdown code fences."""
    return F.trim(F.regexp_replace(x, r"```(?:json)?", ""))
