"""Patterns on the parts of source code, and what they stand in.

Masks hold no literals and at most ``DEEP`` levels of one kind of bracket (deeper ones are marks, see ``reader``), so
patterns with that many levels match code of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(left: str, right: str, depth: int, none: str = "") -> str:
    """Pattern of balanced brackets up to a nesting depth; ``none`` are further characters that may not stand inside."""
    inner = rf"[{left}][^{left}{right}{none}]*+[{right}]"
    for _ in range(depth):
        inner = rf"[{left}](?:[^{left}{right}{none}]++|{inner})*+[{right}]"
    return inner


# Brackets that stand in this many others of their kind are written as marks in the mask, so patterns see no deeper ones.
DEEP = 6
LEFT, RIGHT = "\ue000", "\ue001"
# Marks for parentheses, angles, squares and braces.
MARKS = "\ue000\ue001\ue002\ue003\ue004\ue005\ue006\ue007"
PARENS = nested(r"\(", r"\)", DEEP)
ANGLES = nested("<", ">", DEEP)
BRACES = nested(r"\{", r"\}", DEEP)
SQUARES = nested(r"\[", r"\]", DEEP)
# Java's letters and digits; for use inside a character class.
WORD = r"\p{L}\p{Nl}\p{Sc}\p{Pc}\p{Mn}\p{Mc}\p{Nd}"
NAME = rf"[\p{{L}}\p{{Nl}}\p{{Sc}}\p{{Pc}}][{WORD}]*"
CASES = ("case", "default")
TYPES = ("class", "interface", "enum", "record")


def unmarked(text: Column) -> Column:
    """Marks as the brackets they stand for."""
    return F.translate(text, MARKS, "()<>[]{}")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def by_file(df: DataFrame) -> DataFrame:
    """Hash by file id into a fixed number of partitions: what the tables of one file do next needs no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def strip_brackets(mask: Column) -> Column:
    """Drop bracketed content, then what is in angle brackets."""
    bare = F.regexp_replace(mask, nested(r"({\[", r")}\]", 3 * DEEP), "")
    return F.regexp_replace(bare, nested("<", ">", DEEP, "="), "")
