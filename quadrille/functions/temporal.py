"""Temporal column functions: granularity levels, date parsing, buckets.  No UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("year", "month", "day")

# Month names, their short forms, and the pattern of time expressions.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_FORMS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
TIME_PATTERN = (
    r"\b(?:\d{4}(?:-\d{1,2}(?:-\d{1,2})?)?|\d{1,2}-\d{1,2}-\d{4})\b"
    r"|\b(?:\d{1,2}\s)?(?:" + MONTH_FORMS + r")\s?\d{1,2}?(?:\s|,)?\s?\d{2,4}\b"
)
DATE_ENTITY_PATTERNS = (r"^\d{4}$", r"^\d{4}-\d{1,2}(-\d{1,2})?$", r"^\d{1,2}\s+[a-z]{3,9}\s+\d{4}$", r"^[a-z]{3,9}\s+\d{4}$", r"^\d{1,2}\s+[a-z]{3,9}$")
ORGANISATION_WORDS = "institute|university|organization|council"


def truncate(d: Column, level: Column) -> Column:
    """The first day of the year, month or day; null for another level."""
    d = d.cast("date")
    return F.when(level == "year", F.trunc(d, "year")).when(level == "month", F.trunc(d, "month")).when(level == "day", d)


def matches(d: Column, anchor: Column, level: Column) -> Column:
    """Equal at a level; a null date or an unknown level is no match."""
    return F.coalesce(truncate(d, level) == truncate(anchor, level), F.lit(False))


def compare(a: Column, b: Column, level: Column) -> Column:
    """-1, 0 or 1 at a level; 0 for an unknown level or a null."""
    return F.coalesce(F.signum(F.datediff(truncate(a, level), truncate(b, level))).cast("int"), F.lit(0))


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its short form, else null."""
    head = F.substring(F.lower(name), 1, 3)
    out = F.lit(None).cast("int")
    for k, month in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(head == month[:3], F.lit(k)).otherwise(out)
    return out


def _iso(y: Column, m: Column, d: Column) -> Column:
    """A date from integers, null if there is no such day."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def parse_iso(text: Column) -> Column:
    """Y, Y-M or Y-M-D as the first day of that period; null if it is none."""
    return once(F.trim(text), _iso_period)


def once(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` bound by a lambda: a long body that names its input often, inlined at each
    use, would outgrow a compiled method."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _iso_period(t: Column) -> Column:
    year, month, day = (F.nullif(F.regexp_extract(t, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", i), F.lit("")).cast("int") for i in (1, 2, 3))
    return _iso(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))


def parse_text_date(text: Column) -> Column:
    """The first date in a text: ``[D] Month YYYY``, then ``YYYY-MM[-DD]``, then ``in|on YYYY``.
    An impossible day becomes day 1."""
    return once(text, _named_or_iso)


def _named_or_iso(text: Column) -> Column:
    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    # The three patterns of dates in texts, this one, ``iso`` and the one of a year.
    named = r"(?i)(?:(\d{1,2})\s+)?(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})"
    y, m, d = part(named, 3).cast("int"), month_number(part(named, 2)), F.coalesce(part(named, 1).cast("int"), F.lit(1))
    by_name = F.coalesce(_iso(y, m, d), _iso(y, m, F.lit(1)))
    iso = r"\b(\d{4})-(\d{2})(?:-(\d{2}))?\b"
    y, m, d = part(iso, 1).cast("int"), part(iso, 2).cast("int"), F.coalesce(part(iso, 3).cast("int"), F.lit(1))
    by_iso = F.coalesce(_iso(y, m, d), _iso(y, m, F.lit(1)))
    by_year = _iso(part(r"(?i)\b(?:in|on)\s+(\d{4})\b", 1).cast("int"), F.lit(1), F.lit(1))
    return F.when(part(named, 3).isNotNull(), by_name).when(part(iso, 1).isNotNull(), by_iso).otherwise(by_year)


def time_expression(text: Column) -> Column:
    """The first time expression as ``YYYY[-MM[-DD]]`` at its own granularity, else null.

    Digits in ``D-M-YYYY`` are month first unless that is impossible; a two-digit year is in
    1969-2068; an English expression's granularity is its number of space-separated parts."""
    return once(F.nullif(F.regexp_extract(text, TIME_PATTERN, 0), F.lit("")), _expression)


def _expression(hit: Column) -> Column:
    def num(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(hit, pattern, i), F.lit("")).cast("int")

    def show(y: Column, m: Column | None = None, d: Column | None = None) -> Column:
        out = F.lpad(y.cast("string"), 4, "0")
        for x in (m, d):
            out = out if x is None else F.concat(out, F.lit("-"), F.lpad(x.cast("string"), 2, "0"))
        return out

    ymd, ym, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    a, b, c = (num(dmy, i) for i in (1, 2, 3))
    first_is_month = a <= 12
    month, day = F.when(first_is_month, a).otherwise(b), F.when(first_is_month, b).otherwise(a)
    english = r"(?:(\d{1,2})\s)?(" + MONTH_FORMS + r")\s?(?:(\d{1,2})(?:,\s?|\s,?\s?))?(\d{2,4})$"
    ed, em, ey = F.coalesce(num(english, 1), num(english, 3)), month_number(F.nullif(F.regexp_extract(hit, english, 2), F.lit(""))), num(english, 4)
    ey = F.when(ey >= 100, ey).when(ey < 69, ey + 2000).otherwise(ey + 1900)
    parts = F.size(F.split(hit, " "))
    return (
        F.when(hit.rlike(ymd), F.when(_iso(num(ymd, 1), num(ymd, 2), num(ymd, 3)).isNotNull(), show(num(ymd, 1), num(ymd, 2), num(ymd, 3))))
        .when(hit.rlike(dmy), F.when(_iso(c, month, day).isNotNull(), show(c, month, day)))
        .when(hit.rlike(ym), F.when(num(ym, 2).between(1, 12), show(num(ym, 1), num(ym, 2))))
        .when(hit.rlike(r"^\d{4}$"), hit)
        .when((parts == 3) & ed.isNotNull(), F.when(_iso(ey, em, ed).isNotNull(), show(ey, em, ed)))
        .when(parts == 2, show(ey, em))
        .when(em.isNotNull(), show(ey))
    )


def is_date_entity(text: Column, compat: bool = False) -> Column:
    """Whether a name is a time expression.  ``compat`` finds month names inside other words, too."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    shaped = F.lit(False)
    for p in DATE_ENTITY_PATTERNS:
        shaped = shaped | t.rlike(p)
    names = "|".join(MONTHS)
    month = t.rlike(names if compat else rf"\b(?:{names})\b") & ~t.rlike(ORGANISATION_WORDS)
    return F.coalesce((F.length(text) > 0) & (shaped | month), F.lit(False))


def kappa(d: Column, cue: Column, anchor: Column, ordinal: Column, delta: int = 1) -> Column:
    """The bucket in which facts with the same subject, relation and object are one.

    before, after: whole steps of ``delta`` days from the anchor (or from day 1 of year 1);
    first, last: the fact's ordinal; else its day."""
    day = F.datediff(d, F.lit("0001-01-01").cast("date")) + 1
    steps = F.floor(F.coalesce(F.datediff(d, anchor), day) / F.lit(delta)).cast("long")
    return F.when(cue.isin("before", "after"), steps).when(cue.isin("first", "last"), ordinal.cast("long")).otherwise(day.cast("long"))


def parse_fact(text: Column) -> Column:
    """struct(s, r, o, d) of a tab-separated fact; null with fewer than four parts or a bad day."""
    parts = F.split(text, "\t", -1)
    d = F.when(F.get(parts, F.lit(3)).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(F.get(parts, F.lit(3)), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))
    s, r, o = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when((F.size(parts) >= 4) & d.isNotNull(), F.struct(s.alias("s"), r.alias("r"), o.alias("o"), d.alias("d")))


def render_fact(s: Column, r: Column, o: Column, d: Column) -> Column:
    """``s r o date`` parted by tabs; a static fact's time is the text None."""
    return F.concat_ws("\t", s, r, o, F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("None")))


def render_sentence(s: Column, r: Column, o: Column, d: Column) -> Column:
    return F.concat(F.concat_ws(" ", s, r, o), F.lit(" in "), F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("None")))
