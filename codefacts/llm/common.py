"""Helpers that the operators share: rows with a key of their own, words and hashes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Fixed: the bytes that part words, and the same as a Spark regular expression.
SPACES = b"\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(1 << 63)


def prepare(spark: SparkSession) -> SparkSession:
    """Rows of whole texts go to Python in small batches, so memory follows a batch and not a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # a job's shuffle files go when it ends, not when the driver happens to collect its garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, text): rid is a hash of the text, so (id, rid) tells rows apart unless they are whole copies.

    A null id becomes the smallest long and a null text the empty text; other columns, whatever their names, stay out.
    """
    return docs.select(
        F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"),
    ).select("id", F.xxhash64("text").alias("rid"), "text")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row, however often they are used.

    The optimizer copies an expression into every filter and field that refers to it, which multiplies with each level.
    It doesn't look through an explode, here of an array of one.
    """
    one = F.struct(*(c.alias(n) for n, c in columns.items()))
    df = df.withColumn("__one", F.explode(F.array(one)))
    return df.withColumns({n: F.col("__one")[n] for n in columns}).drop("__one")


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows, never more: those whose keys have the smallest hashes.

    A count sets a limit on the hash first, so the tasks pass on about ``most`` rows between them and not each.
    """
    share = min(1.0, 1.2 * most / max(1, df.count()))
    low = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    return df.filter(F.xxhash64(*key) <= low).orderBy(F.xxhash64(*key), *key).limit(most)


def settled(counts: DataFrame, name: str) -> DataFrame:
    """An aggregate as a table. A join with it reads plain shuffles on both sides, so a hot key's rows can be split
    among tasks; joined as it stands, the aggregate would hold all rows of its keys in one task."""
    return materialize(counts, name)


def only_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` (id_col, text_hash) names, whole copies once.

    Of rows with equal id and text whose other columns differ, the one with the smallest hash of all columns stays.
    """
    keys = {"__id": F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)), "__rid": F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit("")))}
    wanted = kept.select(F.coalesce(named(id_col), F.lit(NO_ID)).alias("__id"), F.col("text_hash").alias("__rid"))
    order = Window.partitionBy("__id", "__rid").orderBy(F.xxhash64(*(named(c) for c in docs.columns)))
    found = docs.withColumns(keys).join(wanted, ["__id", "__rid"], "left_semi")
    return found.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").select(*(named(c) for c in docs.columns))


FILTER_BYTES = 1 << 24


class Members:
    """A Bloom filter of row keys, at most FILTER_BYTES long. What it holds it always finds; of other rows it finds about
    one in fifty while there are up to 16 million keys, and more beyond, so it may only spare work and not decide."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(ids: np.ndarray, rids: np.ndarray, n_words: int) -> np.ndarray:
        """Four bits per key: (4, keys)."""
        h = mixed(mixed(ids.view(np.uint64)) ^ rids.view(np.uint64))
        step = mixed(h) | np.uint64(1)
        return (h + np.arange(4, dtype=np.uint64)[:, None] * step) % np.uint64(64 * n_words)

    def has(self, ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
        at = self.places(ids, rids, len(self.words))
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def only(self, batches: Iterator[pa.RecordBatch], found: bool = True) -> Iterator[pa.RecordBatch]:
        """The rows that the filter finds, or those that it doesn't."""
        for batch in batches:
            yield batch.filter(pa.array(self.has(np.asarray(batch.column("id")), np.asarray(batch.column("rid"))) == found))


def members(keys: DataFrame) -> Members:
    """The filter of a written table (id, rid), filled by the tasks; only its words that aren't zero come to the driver.

    A function that holds it is broadcast with it by Spark.
    """
    n_words = max(1, min(FILTER_BYTES // 8, keys.count() // 8))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Members.places(np.asarray(batch.column("id")), np.asarray(batch.column("rid")), n_words).ravel()
            bits = signed(np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["word", "bits"])

    filled = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_words, np.uint64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return Members(out)


def shown_id(name: str) -> Column:
    """The id column under its own name, null again where it was null."""
    return F.when(F.col("id") != NO_ID, F.col("id")).alias(name)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = stream(256, 1) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2^64; kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """Words of several texts at once: starts and ends in ``data`` (bytes), the text each lies in, and their hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(_IS_WORD[raw], prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.text_starts)  # of each text, its first word; one more at the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        raw = np.frombuffer(self.data, np.uint8)
        up, down = powers(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = max(0, len(words) - k + 1)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += words[j : j + n] * np.uint64(factor)
        factor = factor * int(_GRAM) % (1 << 64)
    return mixed(out)


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds about ``most`` bytes of text at most (a longer text comes by itself)."""
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
