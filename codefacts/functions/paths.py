"""Column functions on file paths, and translation of shell patterns to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import LANGUAGE_SUFFIXES

# Characters that the glob translation escapes (fixed values).
GLOB_SPECIAL = r"\.+^${}()|[]"


def relative_path(path: Column, skip: int = 5) -> Column:
    """Drop the first ``skip`` segments of a stored path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(skip + 1), F.greatest(F.size(parts) - skip, F.lit(0))), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix in lower case, or ``(none)``; leading dots of a name start no suffix."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))
    return F.when(suffix == "", F.lit("(none)")).otherwise(suffix)


def detect_language(path: Column, registry: dict[str, tuple[str, ...]] = LANGUAGE_SUFFIXES) -> Column:
    """Language by case-sensitive suffix, null when no registered suffix fits."""
    result = F.lit(None).cast("string")
    for language, suffixes in registry.items():
        for suffix in suffixes:
            result = F.when(path.endswith(suffix), F.lit(language)).otherwise(result)
    return result


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, shortest first; empty for a file at the root."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``**`` crosses directories, ``*`` and ``?`` do not."""
    pieces = re.findall(r"\*\*/?|.", pattern, flags=re.S)
    wild = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(p, "\\" + p if p in GLOB_SPECIAL else p) for p in pieces) + "$"


def literal_prefix(pattern: str) -> str:
    """The part of a glob before its first wildcard: a ``startswith`` filter the scan can use."""
    return re.split(r"[*?\[]", pattern, maxsplit=1)[0]


def fnmatch_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``)."""
    def one(match: re.Match) -> str:
        piece = match.group(0)
        if piece == "*":
            return ".*"
        if piece == "?":
            return "."
        if len(piece) > 1:
            body = piece[1:-1].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            if body.startswith("!"):
                return f"[^{body[1:]}]"
            return "[\\^" + body[1:] + "]" if body.startswith("^") else f"[{body}]"
        return re.escape(piece)

    return "(?s)^" + re.sub(r"\[!?\]?[^\]]*\]|.", one, pattern, flags=re.S) + "$"
