"""Secret scans in DataFrame functions only: fixed patterns, and Shannon entropy in sliding windows.

Entries of the allow-list part a candidate into pieces; what they match is no secret, whatever lies beside it. A piece
falls into the narrowest character class that holds all its characters, and a window of the class's width slides over it.
One character comes in and one goes out, so two counts change and with them two terms of the sum of c log2 c, from which
the entropy follows. Where it exceeds the class's threshold, the stretch from the first to the last such window is a
span. A piece shorter than its class's window is one window, with a threshold scaled to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, named, prepare

#: Fixed: the base patterns, the group whose length counts, and the least length. Runs of the last two kinds end only at
#: another character, so asking for their length in the pattern finds the same ones as dropping short matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 1, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
KINDS = ("assign", "access", "hex", "entropy")

#: Fixed: what is no secret however it looks: UUIDs with no hex digit beside them, placeholders, runs of the alphabet or
#: of digits, and six or more of a character in a row.
UUID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"
PLACEHOLDERS = "example|sample|placeholder|changeme|dummy|redacted|0123456|1234567|abcdefg"
RUNS = "|".join(f"[{c}]{{6,}}" for c in "0123456789abcdefghijklmnopqrstuvwxyz+/_=-")
#: UUIDs are masked first, by a character that no candidate holds.
MASK = "~"
PARTING = f"(?i){MASK}+|{PLACEHOLDERS}|{RUNS}"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of these characters only; ``more`` is the entropy in bits that a window has to exceed."""

    name: str
    alphabet: str
    window: int
    more: float


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("hex", _DIGITS + "ABCDEFabcdef", 16, 2.9),
    CharacterClass("alphanumeric", _DIGITS + _UPPER + _LOWER, 20, 3.77),
    CharacterClass("base64", _DIGITS + _UPPER + _LOWER + "+/_=-", 24, 3.99),
)
SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Windows that start in one block are walked together.
BLOCK = 512
MIXED = r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"

_SPAN = "array<struct<start:int,end:int,text:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost matches without overlap: array of (start, end, text of the group), in code points.

    What lies between them comes from split by the same pattern, so their places are sums of lengths. Texts without a
    match cost one search.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), parts.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    walked = F.aggregate(zipped, start, lambda s, z: F.struct(
        (s["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
        F.concat(s["out"], F.array(F.struct(
            (s["at"] + F.length(z["gap"])).alias("start"), (s["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("end"),
            z["part"].alias("text"),
        ))).cast(_SPAN).alias("out"),
    ), lambda s: s["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPAN))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; ``get`` would compute its array twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(window: Column) -> Column:
    """The sum of c log2 c over the characters of a text, c their counts."""
    counts = F.transform(F.array_distinct(F.split(window, "")), lambda c: _count(window, c))
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0))


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def _block_ends(text: Column, w: int, more: float) -> Column:
    """(first, last) of the windows of w characters in a text of bounded length, as ``high_entropy`` has them."""
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 1)))
    most = w * (math.log2(w) - more)  # a window is above the threshold where its sum is below this
    start = F.struct(_sum(F.substring(text, 1, w)).alias("sum"))
    start = _let(start, lambda s: F.struct(
        s["sum"].alias("sum"), (s["sum"] < most).cast("int").alias("first"), F.when(s["sum"] < most, w).otherwise(0).alias("last"),
    ))

    def step(s: Column, i: Column) -> Column:
        seen = F.struct(
            F.substring(text, i, F.lit(1)).alias("came"), F.substring(text, i - w, F.lit(1)).alias("gone"),
            F.substring(text, i - w + 1, F.lit(w - 1)).alias("stay"),
        )
        total = _let(seen, lambda c: F.when(c["came"] == c["gone"], s["sum"]).otherwise(moved(c, s["sum"])))
        return _let(total, lambda total: F.struct(
            total.alias("sum"),
            F.when((total < most) & (s["first"] == 0), i - w + 1).otherwise(s["first"]).alias("first"),
            F.when(total < most, i).otherwise(s["last"]).alias("last"),
        ))

    def moved(c: Column, total: Column) -> Column:
        """The sum after one character came and another went: only their two counts, by one each, have changed."""
        both = F.struct(_count(c["stay"], c["came"]).alias("up"), _count(c["stay"], c["gone"]).alias("down"))
        return _let(both, lambda n: total + term(n["up"] + 1) - term(n["up"]) + term(n["down"]) - term(n["down"] + 1))

    def term(c: Column) -> Column:
        return F.element_at(table, c + 1)

    rest = F.slice(F.sequence(F.lit(w), F.length(text)), 2, F.length(text))
    return F.aggregate(rest, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def high_entropy(text: Column, kind: CharacterClass) -> Column:
    """(first, last): ends of the stretch of windows above the threshold, 1-based and inclusive; 0 where there is none.

    The windows are walked in blocks by where they start, so a place in a long text isn't looked for from its beginning
    and rounding errors end with a block. The text has at least one window.
    """
    w = kind.window
    blocks = F.transform(F.sequence(F.lit(0), F.length(text) - w, F.lit(BLOCK)), lambda at: F.struct(
        at.alias("at"), _let(F.substring(text, at + 1, F.lit(BLOCK + w - 1)), lambda part: _block_ends(part, w, kind.more)).alias("ends"),
    ))
    none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.filter(blocks, lambda b: b["ends"]["first"] > 0), none, lambda s, b: F.struct(
        F.when(s["first"] == 0, b["at"] + b["ends"]["first"]).otherwise(s["first"]).alias("first"),
        (b["at"] + b["ends"]["last"]).alias("last"),
    ))


def high_as_one(text: Column, kind: CharacterClass) -> Column:
    """As ``high_entropy`` for a text shorter than the window: all of it is one window, and the threshold is the same
    share of the entropy that so many different characters have."""
    n = F.length(text)
    above = F.log2(n) - _sum(text) / n > F.log2(n) * (kind.more / math.log2(kind.window))
    return F.struct(F.when(above, 1).otherwise(0).alias("first"), F.when(above, n).otherwise(0).alias("last"))


def pieces(text: Column) -> Column:
    """What the allow-list leaves of a text: array of (start, end, text), in code points."""
    masked = F.regexp_replace(text, UUID, MASK * 36)
    gaps, hits = F.split(masked, PARTING, -1), F.regexp_extract_all(masked, F.lit(PARTING), F.lit(0))
    walked = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda s, z: F.struct(
            (s["at"] + F.length(z["gap"]) + F.coalesce(F.length(z["hit"]), F.lit(0))).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                s["at"].alias("start"), (s["at"] + F.length(z["gap"])).alias("end"), z["gap"].alias("text"),
            ))).cast(_SPAN).alias("out"),
        ), lambda s: s["out"])
    one = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"))).cast(_SPAN)
    return F.when(masked.rlike(PARTING), walked).otherwise(one)


def _inside(kind: CharacterClass) -> str:
    return "^[" + kind.alphabet.replace("-", "") + ("-" if "-" in kind.alphabet else "") + "]+$"


def _base(text: Column, k: int) -> Column:
    _, pattern, group, least = BASE[k]
    hits = F.filter(matches(text, pattern, group), lambda m: F.length(m["text"]) >= least)
    return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))


def _candidates(text: Column) -> Column:
    found = F.filter(matches(text, CANDIDATE), lambda m: m["text"].rlike(MIXED))
    parted = F.flatten(F.transform(found, lambda m: F.transform(pieces(m["text"]), lambda p: F.struct(
        (m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["text"].alias("text"),
    ))))
    return F.filter(parted, lambda p: (F.length(p["text"]) >= SHORTEST) & p["text"].rlike(MIXED))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__spans``: array of (start, kind, end) of every secret, by start and then kind (place in KINDS).

    Code points, end exclusive. A null or empty text has none. Rows are scanned by themselves, so ids, repeated rows
    and other columns make no difference; names that begin with two underscores are the operator's own. Base spans are
    all kept; an entropy span inside one is left out.
    """
    prepare(docs.sparkSession)
    df = computed(docs, __text=F.coalesce(named(text_col).cast("string"), F.lit("")))
    base = [_base(F.col("__text"), k) for k in range(len(BASE))]
    df = computed(df, __base=F.concat(*base), __candidates=_candidates(F.col("__text")))
    found = F.transform("__candidates", lambda m: F.struct(m["start"].alias("start"), _classes(m["text"]).alias("at")))
    df = computed(df, __found=F.filter(found, lambda c: c["at"]["first"] > 0))
    entropy = F.filter(F.transform("__found", lambda c: F.struct(
        (c["start"] + c["at"]["first"] - 1).alias("start"), F.lit(3).alias("kind"), (c["start"] + c["at"]["last"]).alias("end")
    )), lambda e: ~F.exists("__base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    df = computed(df, __spans=F.array_sort(F.concat("__base", entropy)))
    return df.drop("__text", "__base", "__candidates", "__found")


def _classes(text: Column) -> Column:
    out = None
    for kind in CLASSES:
        high = high_entropy(text, kind)
        if kind.window > SHORTEST:
            high = F.when(F.length(text) < kind.window, high_as_one(text, kind)).otherwise(high)
        inside = text.rlike(_inside(kind))
        out = F.when(inside, high) if out is None else out.when(inside, high)
    return out


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of spans replaced by one mark."""
    walked = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, m: F.struct(
            F.when(m["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(mark)))
            .otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], m["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
