"""Spelling variants: words one edit apart, found in blocks of the vocabulary that are indexed both ways."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_table, new_table_path
from .common import named
from .fm_index import Vocabulary

#: Fixed: the letters of a run, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a block of the index, letters in one index, and words looked up at a time.
BLOCK, LETTERS, BATCH = 1 << 15, 1 << 20, 1 << 12
_LAST = "\U0010ffff"


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 199, shortest: int = 6, rarest: int = 5
) -> DataFrame:
    """(word, n) of the runs of letters in whole texts, A-Z lower-cased.

    With ``spoil``, a run whose crc32 of ``<id>:<run>`` that number divides loses one letter, the one at crc32 % length.
    Counts are partial sums before the shuffle.

    A null text has no words; a null id is written ``null``.
    """
    text = F.translate(named(text_col).cast("string"), _UPPER, _LOWER)
    runs = docs.select(
        F.coalesce(named(id_col).cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if spoil:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % spoil == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rarest)


def _bounded(words: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of words with about ``most`` letters each."""
    start, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield start, i
            start, size = i, 0
        size += len(w) + 1
    if start < len(words):
        yield start, len(words)


_DEALT = "block int, slice int, word string, n long"


def _rows(blocks: list[int], slices: list[int], words: list[str], n: list[int]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip((blocks, slices, words, n), kinds, strict=True)], ["block", "slice", "word", "n"])


def _look_up(side: str):
    """Words and queries of one block to what is near each query: (word, n_near, best_n, best)."""

    def run(group: pa.Table) -> pa.Table:
        words, counts = group.column("word").to_pylist(), group.column("n").to_numpy()
        order = sorted(np.flatnonzero(counts > 0).tolist(), key=words.__getitem__)
        listed, n = [words[i] for i in order], counts[order]
        asked = [words[i] for i in np.flatnonzero(counts == 0).tolist()]
        total, best, where = (np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64))
        for start, stop in _bounded(listed, LETTERS):
            index, size = Vocabulary(listed[start:stop]), n[start:stop]
            for first, last in _bounded(asked, BATCH * 16):
                query, word = index.near(asked[first:last], side)
                if side == "right" and len(query):  # pairs with equal left halves are the other side's
                    own = [not index.words[w].startswith(asked[first + a][: len(asked[first + a]) // 2]) for a, w in zip(query.tolist(), word.tolist(), strict=True)]
                    query, word = query[own], word[own]
                if not len(query):
                    continue
                query = query + first
                total += np.bincount(query, minlength=len(asked))
                by = np.lexsort((word, -size[word], query))
                query, word = query[by], word[by]
                lead = np.diff(query, prepend=-1) != 0
                query, word = query[lead], word[lead]
                more = size[word] > best[query]  # a tie stays with the smaller word, which came first
                best[query[more]], where[query[more]] = size[word[more]], start + word[more]
        some = np.flatnonzero(total)
        return pa.table({
            "word": pa.array([asked[i] for i in some], pa.string()), "n_near": total[some], "best_n": best[some],
            "best": pa.array([listed[where[i]] for i in some], pa.string()),
        })

    return run


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have another word of ``vocabulary`` (word, n) one edit away: how many,
    and the one of largest n (ties: the smallest).

    An error lies in one half of a word only, so the other stands in its neighbour as it is. The vocabulary is sorted
    into blocks once from the left and once from the right, and a word asks the blocks its half leads to: one or two,
    or as many as words share the half, whose queries are then dealt in slices. A task holds one block and one slice;
    what the driver holds is the first and last word of each block, one pair per ``block`` words.
    """
    spark = vocabulary.sparkSession
    n_blocks = -(-vocabulary.count() // block)
    if not n_blocks:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    out = None
    for side in ("left", "right"):
        key = F.col("word") if side == "left" else F.reverse("word")
        path = new_table_path(spark, "vocabulary")
        vocabulary.withColumn("key", key).repartitionByRange(n_blocks, "key").withColumn(
            "block", F.spark_partition_id()).write.parquet(path)
        dealt = spark.read.schema("word string, n long, key string, block int").parquet(path)
        ends = dealt.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("block").collect()
        numbers, lows, highs = [r["block"] for r in ends], [r["low"] for r in ends], [r["high"] for r in ends]

        def ask(batches, slices=None, side=side, numbers=numbers, lows=lows, highs=highs):
            for batch in batches:
                words, blocks, kept = batch.column("word").to_pylist(), [], []
                for i, w in enumerate(words):
                    half = w[: len(w) // 2] if side == "left" else w[len(w) // 2 :][::-1]
                    hit = numbers[bisect_left(highs, half) : bisect_right(lows, half + _LAST)]
                    blocks += hit
                    kept += [i] * len(hit)
                dealt_to = [zlib.crc32(words[i].encode()) % slices[b] for i, b in zip(kept, blocks, strict=True)] if slices else [0] * len(kept)
                yield _rows(blocks, dealt_to, [words[i] for i in kept], [0] * len(kept))

        asked = dealt.select("word").mapInArrow(ask, _DEALT).groupBy("block").count().collect()
        slices = {r["block"]: -(-r["count"] // (4 * block)) for r in asked}

        def spread(batches, slices=slices):
            for batch in batches:
                blocks = batch.column("block").to_pylist()
                kept = [(i, s) for i, b in enumerate(blocks) for s in range(slices.get(b, 0))]
                words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
                yield _rows([blocks[i] for i, _ in kept], [s for _, s in kept], [words[i] for i, _ in kept], [n[i] for i, _ in kept])

        queries = dealt.select("word").mapInArrow(lambda batches, ask=ask, slices=slices: ask(batches, slices), _DEALT)
        found = dealt.mapInArrow(spread, _DEALT).unionByName(queries).groupBy("block", "slice").applyInArrow(
            _look_up(side), "word string, n_near long, best_n long, best string")
        done = new_table_path(spark, "near")
        found.write.parquet(done)
        delete_table(spark, path)
        found = spark.read.schema(found.schema).parquet(done)
        out = found if out is None else out.unionByName(found)
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t")).select(
        "word", "n_near", (-F.col("t.m")).alias("best_n"), "t.best")


def variants(vocabulary: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary`` (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least ``ratio``
    times its own; its root is where its forms end. Each step multiplies n, so chains are short and doubling the steps
    needs a round or two. Words of one letter's difference are grouped with no cap on how many are near.

    Defined cases: no words give no rows; a word without near words has 0, no form, and is its own root.
    """
    spark = vocabulary.sparkSession
    path = new_table_path(spark, "words")
    vocabulary.select("word", "n").write.parquet(path)
    words = spark.read.schema("word string, n long").parquet(path)
    path = new_table_path(spark, "forms")
    joined = words.join(near_words(words, block), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best")).alias("form"),
                  F.when(takes, F.col("best_n")).alias("form_n")).write.parquet(path)
    formed = spark.read.schema("word string, n long, n_near long, form string, form_n long").parquet(path)
    steps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    before = None
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        path = new_table_path(spark, "roots")
        steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).write.parquet(path)
        moved = spark.read.schema("word string, root string, moved boolean").parquet(path)
        if before:
            delete_table(spark, before)
        steps, before = moved.select("word", "root"), path
        if moved.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, **counted) -> DataFrame:
    """``variants`` of the words of whole documents; ``counted`` goes to ``word_counts``, whose defined cases hold."""
    return variants(word_counts(docs, id_col, text_col, **counted), ratio)
