"""Mixing sources to target weights: hash thresholds that spend each source's budget, found without sorting."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import positions
from ..session import delete_table, new_table_path
from .common import WORD, named


class _Tables:
    """Tables of one run; all but the kept ones go at the end."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_table_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *kept: DataFrame) -> None:
        inputs = [f for df in kept for f in df.inputFiles()]
        for path in self.paths:
            if not any(path.rsplit("/", 1)[-1] in f for f in inputs):
                delete_table(self.spark, path)


def targets(sources: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """``sources(key, weight_no, total)`` with ``target``: shares of ``share`` times all totals by weight, none above
    ``most`` times its source's total; what is above goes to the others by weight, until none is above.

    The driver keeps one number, the words per unit of weight; each round adds the sources it caps, in one aggregate.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.col("weight_no") + 1)
    cap = F.col("total") * most
    budget = share * (sources.agg(F.sum("total")).first()[0] or 0)
    rate, before = Fraction(0), None
    while True:
        full = cap <= weight * F.lit(float(rate))
        got = sources.agg(
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, weight)).alias("open"), F.count_if(full).alias("n")
        ).first()
        if not got["open"] or got["n"] == before:
            break
        rate, before = max(rate, (budget - (got["capped"] or 0)) / got["open"]), got["n"]
    shares = F.element_at(F.array(*(F.lit(float(rate * w)) for w in weights)), F.col("weight_no") + 1)
    return sources.withColumn("target", F.when(cap <= weight * F.lit(float(rate)), cap.cast("double")).otherwise(F.least(shares, cap.cast("double"))))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int, tables: _Tables) -> DataFrame:
    """Per key the smallest hash whose rows no longer fit: (key, hi, left), left being the budget below it that is unspent.

    ``rows(key, h, size)`` are summed by key and the top ``bits`` bits of the hash; the bucket in which the running sum
    passes the key's budget is split by the next bits, and the others aren't read again. A key whose rows all fit is
    absent. Rows with equal hashes go together.
    """
    done, shift = None, 64
    while True:
        shift = max(0, shift - bits)
        bucket = F.shiftright("h", shift)
        sums = rows.groupBy("key", bucket.alias("b")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        past = sums.withColumn("upto", F.sum("words").over(run)).join(budgets, "key").filter("upto > budget")
        edge = past.groupBy("key").agg(F.min_by(F.struct("b", "low", "high", (F.col("budget") - F.col("upto") + F.col("words")).alias("left")), "b").alias("e"))
        edge = tables.write(edge.select("key", "e.*"), "mix_edge")
        found = edge.filter("low = high").select("key", F.col("low").alias("hi"), "left")
        done = found if done is None else done.unionByName(found)
        open_ = edge.filter("low < high")
        if not shift or open_.isEmpty():
            return done
        budgets = open_.select("key", F.col("left").alias("budget"))
        rows = tables.write(rows.withColumn("b", bucket).join(open_.select("key", "b"), ["key", "b"]).drop("b"), "mix_bucket")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    bits: int = 12,
    near: float = 0.0005,
) -> DataFrame:
    """How often the mix takes each document: (id, size, source_size, target, taken, copies).

    Sources in order of their code points, null last, have ``weights`` in turn. A source gives whole rounds of all its
    documents, and one more round of those whose hash of id and text is below the source's threshold: thresholds are
    nested, so a larger target keeps what a smaller one took. What the document on the threshold leaves unspent goes to
    smaller documents beyond it by a threshold of their own, as long as more than ``near`` of the target is unspent and
    one fits; at last one more goes in where that comes nearer. No document is cut, none is sorted.

    Defined cases: a null text has no words, a null id is hashed as such, and null is a source of its own. Equal ids with
    equal texts share a hash and go together; documents without words are taken with no words. Other columns stay
    out, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = _Tables(spark)
    text, source = F.coalesce(named(text_col).cast("string"), F.lit("")), named(source_col).cast("string")
    rows = tables.write(docs.select(
        named(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(named(id_col), text).alias("h"),
    ), "mix_rows")
    totals = tables.write(rows.groupBy("key").agg(F.sum("size").alias("total")), "mix_totals")
    ranked = positions(totals, [], ["key"], "place")  # "t" stands behind everything that begins with "s"
    ranked = tables.write(ranked.withColumn("weight_no", (F.col("place") % len(weights)).cast("int")), "mix_sources")
    plan = targets(ranked, weights, share, most)
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    plan = tables.write(plan.withColumn("full", full.cast("long")).withColumn("budget", F.col("target") - F.col("full") * F.col("total")), "mix_plan")

    nothing = F.lit(None).cast("long")
    open_ = plan.filter("budget >= 1").select("key", "target", "budget", nothing.alias("lo"), nothing.alias("largest"))
    ranges = None
    while True:
        inside = (F.col("lo").isNull() | (F.col("h") > F.col("lo"))) & (F.col("largest").isNull() | (F.col("size") <= F.col("largest")))
        some = rows.filter("size > 0").join(open_, "key").filter(inside).select("key", "h", "size")
        found = thresholds(some, open_.select("key", "budget"), bits, tables)
        step = tables.write(open_.join(found, "key", "left"), "mix_range")
        ranges = step if ranges is None else ranges.unionByName(step)
        open_ = step.filter(F.col("hi").isNotNull() & (F.col("left") >= 1) & (F.col("left") > near * F.col("target"))).select(
            "key", "target", F.col("left").alias("budget"), F.col("hi").alias("lo"), F.floor("left").cast("long").alias("largest"))
        if open_.isEmpty():
            break
    # a key has one range per round of filling, each less than the unspent words of the one before
    steps = ranges.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "largest")).alias("steps"))
    plan = tables.write(plan.join(steps, "key", "left").select("key", "total", "target", "full", "steps"), "mix_steps")
    within = F.exists("steps", lambda s: (s["lo"].isNull() | (F.col("h") > s["lo"])) & (s["hi"].isNull() | (F.col("h") < s["hi"]))
                      & (s["largest"].isNull() | (F.col("size") <= s["largest"])))
    within = F.coalesce(within, F.lit(False))
    planned = rows.join(plan, "key").withColumn("in", within)
    spent = planned.groupBy("key", "target").agg(F.sum(F.col("size") * (F.col("full") + F.col("in").cast("long"))).alias("spent"))
    short = tables.write(spent.withColumn("left", F.col("target") - F.col("spent")).filter(F.col("left") > near * F.col("target")).select("key", "left"), "mix_short")
    off = F.abs(F.col("left") - F.col("size"))
    pick = planned.filter(~F.col("in") & (F.col("size") > 0)).join(short, "key").filter(off < F.col("left")).groupBy("key", "left").agg(
        F.min_by("h", F.struct(off, "h")).alias("one"))
    # whole copies share the hash and go together: only if that is nearer still
    group = rows.join(pick, "key").filter("h = one").groupBy("key", "one", "left").agg(F.sum("size").alias("size")).filter(off < F.col("left"))
    plan = tables.write(plan.join(group.select("key", "one"), "key", "left"), "mix_last")
    taken = within | F.coalesce(F.col("h") == F.col("one"), F.lit(False))
    copies = F.col("full") + taken.cast("long")
    out = rows.join(plan, "key").select(
        F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target",
        (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    tables.clear(rows, plan)
    return out
