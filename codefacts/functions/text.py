"""Column functions on texts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit and how many of it make the next unit.
AGE_UNITS: tuple[tuple[str, float], ...] = (
    ("second", 60), ("minute", 60), ("hour", 24), ("day", 7), ("week", 4.345), ("month", 12),
)


# The marks of a cut text, around the number of characters.
MARKED = ("\n\n[...truncated, ", " chars total]")
OMITTED = ("\n... [TRUNCATED — ", " chars omitted]")
NOTHING = "N/A"


def truncate_marked(text: Column, limit: int) -> Column:
    """Keep ``limit`` characters and say how long the text was."""
    marker = F.concat(F.lit(MARKED[0]), F.length(text).cast("string"), F.lit(MARKED[1]))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)


def truncate_omitted(text: Column, limit: int) -> Column:
    """Keep ``limit`` characters and say how many were left out; null becomes ``N/A``."""
    left_out = (F.length(text) - limit).cast("string")
    cut = F.concat(F.substring(text, 1, limit), F.lit(OMITTED[0]), left_out, F.lit(OMITTED[1]))
    return F.when(text.isNull(), F.lit(NOTHING)).when(F.length(text) > limit, cut).otherwise(text)


def truncate_json(value: Column, limit: int) -> Column:
    """Pretty JSON of a nested value, cut like :func:`truncate_omitted`."""
    return truncate_omitted(F.to_json(value, {"pretty": "true"}), limit)


def title(text: Column, limit: int = 50) -> Column:
    """Short title: cut at the last space that leaves room for three dots."""
    head = F.regexp_replace(F.substring(text, 1, limit - 3), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("...")))


def preview(text: Column, limit: int = 50) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def icontains(text: Column, needle: str | None) -> Column:
    """Literal, case-insensitive containment; no needle keeps every row."""
    if needle is None:
        return F.lit(True)
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


CONTEXT_PATTERN = r"^\[Context:\s*(.+?)\s*>\s*(.+?)\]\s*((?s:.*))$"


def parse_context(text: Column, role: Column) -> Column:
    """Struct (content, file_name, node_label) of a user message that starts with a context tag."""
    tagged = role.isin("user", "human") & text.rlike(CONTEXT_PATTERN)

    def part(group: int) -> Column:
        return F.trim(F.regexp_extract(text, CONTEXT_PATTERN, group))

    return F.struct(
        F.when(tagged, F.regexp_extract(text, CONTEXT_PATTERN, 3)).otherwise(text).alias("content"),
        F.when(tagged, part(1)).alias("file_name"),
        F.when(tagged, part(2)).alias("node_label"),
    )


def strip_title(text: Column, role: Column) -> Column:
    """Drop a trailing ``{"title": "..."}`` and blanks from messages that are not the user's."""
    bare = F.regexp_replace(F.regexp_replace(text, r'\s*\{"title"\s*:\s*"[^"]*"\}\s*$', ""), r"\s+$", "")
    return F.when(role.isin("user", "human"), text).otherwise(bare)


def norm_role(role: Column) -> Column:
    return F.when(role.isin("human", "ai", "user"), role).otherwise(F.lit("assistant"))


def age_bucket(ts: Column, now: Column) -> Column:
    """Struct (value, unit) of the time since ``ts``; under five seconds is ``now``."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1000000))
    amount: Column = seconds.cast("double")
    value = F.when(seconds < 5, F.lit(0).cast("long"))
    unit = F.when(seconds < 5, F.lit("now"))
    for name, size in AGE_UNITS:
        value = value.when(amount < size, F.floor(amount))
        unit = unit.when(amount < size, F.lit(name))
        amount = amount / F.lit(float(size))
    return F.struct(value.otherwise(F.floor(amount)).alias("value"), unit.otherwise(F.lit("year")).alias("unit"))
