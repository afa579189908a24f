"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are columns of its row. From labelled rows a decision list is learned by sequential covering:
a conjunction of thresholds grows by information gain until it covers no good row of the growing part, is pruned from
its end on the other part, and joins the list if it is precise enough there; the rows that it covers leave, and the
next one grows. The list is applied as one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, computed, named, prepare, sampled

#: The base limits.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Labelled rows that a list is learned from, at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
PRECISION, LITERALS, RULES, CUTS = 0.97, 4, 16, 64

FEATURES = ("n_words", "word_length", "symbol_share", "upper_share", "repeated_share", "dup_line_share", "line_words")


def _same(words: Column, packed: Column, bits: Column, mask: Column, x: Column, k: Column) -> Column:
    """Whether the window of ``packed[k]`` has the words of the one in ``x``."""
    other = F.get(packed, k)
    here, there = x.bitwiseAND(mask).cast("int"), other.bitwiseAND(mask).cast("int")
    equal = F.call_function("shiftright", x, bits) == F.call_function("shiftright", other, bits)
    for j in range(3):
        equal = equal & (F.get(words, here + j) == F.get(words, there + j))
    return F.coalesce(equal, F.lit(False))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__stats`` of the statistics of each text; a null text has no words.

    Windows of three words that occur twice are found in one sort per row of (hash, position) packed into a long;
    neighbours in that order are compared by their words, so a clash of hashes counts nothing. It could hide a repeat
    only if it fell between two equal windows.
    """
    df = computed(docs, __text=F.coalesce(named(text_col).cast("string"), F.lit("")))
    df = computed(
        df, __words=F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)),
        __lines=F.filter(F.split("__text", "\n", -1), lambda l: l.rlike(WORD)),
    )
    n = F.coalesce(F.size("__words"), F.lit(0))
    df = computed(df, __n=n, __bits=F.length(F.bin(n)), __hashes=F.transform("__words", lambda w: F.xxhash64(w)))
    words, n, bits, hashes = (F.col(c) for c in ("__words", "__n", "__bits", "__hashes"))
    packed = F.sort_array(F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)), bits
        ).bitwiseOR(i.cast("long")),
    ))
    df = computed(
        df, __packed=F.when(n >= 3, packed).otherwise(F.array().cast("array<bigint>")),
        __mask=(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("long"),
    )
    packed, mask = F.col("__packed"), F.col("__mask")
    df = computed(df, __twice=F.sort_array(F.transform(
        F.filter("__packed", lambda x, k: _same(words, packed, bits, mask, x, k - 1) | _same(words, packed, bits, mask, x, k + 1)),
        lambda x: x.bitwiseAND(mask),
    )))
    repeated = F.aggregate(
        "__twice", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda s: s["n"],
    )
    return computed(df, __stats=F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size("__lines").cast("long").alias("n_lines"),
    )).drop("__text", "__words", "__n", "__lines", "__hashes", "__packed", "__bits", "__mask", "__twice")


def _stat(name: str) -> Column:
    return F.col("__stats")[name]


def features() -> dict[str, Column]:
    """What the rules may ask for; shares of nothing are 0."""
    words = F.greatest(_stat("n_words"), F.lit(1))
    lines = F.greatest(_stat("n_lines"), F.lit(1))
    return {
        "n_words": _stat("n_words").cast("double"),
        "word_length": _stat("word_chars") / words,
        "symbol_share": _stat("n_symbols") / words,
        "upper_share": _stat("n_upper") / F.greatest(_stat("word_chars"), F.lit(1)),
        "repeated_share": _stat("n_repeat_words") / words,
        "dup_line_share": _stat("n_dup_lines") / lines,
        "line_words": _stat("n_words") / lines,
    }


def base_failed() -> Column:
    return (_stat("n_words") < LEAST_WORDS) | (100 * _stat("n_repeat_words") > MOST_REPEATED * _stat("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = features()[self.feature]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Literal, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _best_literal(x: np.ndarray, bad: np.ndarray) -> tuple[Literal | None, float]:
    """The threshold with the largest gain of information about bad rows (FOIL's measure)."""
    p0, n0 = bad.sum(), (~bad).sum()
    before = np.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for f, name in enumerate(FEATURES):
        values = np.unique(x[:, f])
        cuts = np.unique((values[:-1] + values[1:]) / 2)
        if len(cuts) > CUTS:
            cuts = np.unique(np.concatenate([np.quantile(cuts, np.linspace(0, 1, CUTS)), np.quantile(x[bad, f], [0.0, 0.01, 0.99, 1.0])]))
        for cut in cuts:
            for above in (True, False):
                hit = x[:, f] > cut if above else x[:, f] <= cut
                p, n = (hit & bad).sum(), (hit & ~bad).sum()
                if p and p * (np.log2(p / (p + n)) - before) > gain:
                    best, gain = Literal(name, above, float(cut)), p * (np.log2(p / (p + n)) - before)
    return best, gain


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION, seed: int = 7) -> list[Rule]:
    """An ordered list of conjunctions that cover bad rows."""
    rules: list[Rule] = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    while len(rules) < RULES and (part & bad).any() and (part & ~bad).any():
        rule: Rule = ()
        inside = part.copy()
        while len(rule) < LITERALS and (inside & ~bad).any():
            literal, _ = _best_literal(x[inside], bad[inside])
            if literal is None:
                break
            rule = (*rule, literal)
            inside &= literal.holds(x)

        def score(r: Rule) -> tuple[float, float]:
            hit = covered(r, x) & ~part
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return ((p - n) / (p + n) if p + n else -1.0, float(p))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=score, default=())
        hit = covered(rule, x) if rule else np.zeros(len(x), bool)
        p, n = (hit & bad & ~part).sum(), (hit & ~bad & ~part).sum()
        if not rule or p == 0 or p / (p + n) < precision or not (hit & bad & part).any():
            break
        rules.append(rule)
        x, bad, part = x[~hit], bad[~hit], part[~hit]
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The list for labelled rows (label 0: bad). At most ``sample`` of them are taken, whatever the size of the tables.

    Rows that fail the base limits need no rule and are left out. Ids that several labels or rows have count once for
    each different match, in all for twice ``sample`` at most; labels without a row, and null labels, count nothing.
    """
    chosen = sampled(labels.select(named(id_col).alias("__id"), named(label_col).alias("__label")).dropna(), sample, "__id", "__label")
    rows = docs.select(named(id_col).alias("__id"), named(text_col).alias("__text0"))
    # the sample is bounded by its parameter, 16 bytes a row
    found = statistics(rows.join(F.broadcast(chosen), "__id"), "__text0").filter(~base_failed()) \
        .select("__id", "__label", *(c.alias(n) for n, c in features().items())).distinct() \
        .orderBy("__id", "__label", *FEATURES).limit(2 * sample).collect()
    x = np.array([list(r)[2:] for r in found], float).reshape(len(found), len(FEATURES))
    return learn(x, np.array([r[1] == 0 for r in found], bool))


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that holds, else null: an ordered CASE expression."""
    out = None
    for k, rule in enumerate(rules):
        condition = F.lit(True)
        for literal in rule:
            condition = condition & literal.column()
        name = " and ".join(f"{l.feature} {'>' if l.above else '<='} {l.threshold:.6g}" for l in rule)
        out = F.when(condition, F.lit(f"{k + 1}: {name}")) if out is None else out.when(condition, F.lit(f"{k + 1}: {name}"))
    return out if out is not None else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the struct columns ``__stats`` and ``__verdict`` (base_failed, rule, kept).

    Each row is judged by its own text alone, so null ids, repeated rows and other columns make no difference; null and
    empty texts fail the base limits. Names that begin with two underscores are the operator's own.
    """
    prepare(docs.sparkSession)
    df = statistics(docs, text_col)
    df = computed(df, __rule=verdict(rules), __failed=base_failed())
    return df.withColumn("__verdict", F.struct(
        F.col("__failed").alias("base_failed"), F.col("__rule").alias("rule"),
        (~F.col("__failed") & F.col("__rule").isNull()).alias("kept"),
    )).drop("__rule", "__failed")
