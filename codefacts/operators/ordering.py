"""Ordered work inside groups of any size.

A window over one key puts the whole key into one task. Here the rows are range-partitioned by (keys, order) instead,
so a hot key spreads over as many partitions as its rows need, whatever the type of the order and however narrow the
range they crowd into. Each partition is sorted and swept once while it is written to the shared folder: every row gets its
rank and the nearest value before it within its partition. Only the first key of a partition can have begun earlier, so
one row per partition carries counts and last values onward, and the rows are not shuffled again. Groups that something
else bounds (a file, a method) say so with ``bounded`` and need one window only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; nulls are equal to each other."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _sweep(keys: list[str], values: list[str]):
    """Sorted batches of one partition with ``_rank`` and ``_l_<value>`` of each row within its key, and with ``_first`` (its
    key is the partition's first), ``_begin`` and ``_end`` (it is the partition's first or last row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, pa.Array] = {}  # the last row's keys, and the last values of its key
        count, first, begun, pending = 0, True, False, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at, new = np.arange(n), np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                new[1:] |= differs(column.slice(0, n - 1), column.slice(1))
                new[0] |= not begun or bool(differs(before[k], column.slice(0, 1))[0])
            new[0] |= not begun
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the key of the batch before goes on
            rank = np.where(start >= 0, at - start, at + count)
            fresh = new.copy()
            fresh[0] &= begun
            ours = np.full(n, first) & ~np.logical_or.accumulate(fresh)
            first, count = bool(ours[-1]), int(rank[-1]) + 1
            out = {c: batch.column(c) for c in batch.schema.names if c not in values}
            for v in values:
                column = batch.column(v)
                held = before.get(v, column.slice(0, 0))
                held = held if len(held) else pa.nulls(1, column.type)
                last = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), at, -1))
                prior = np.concatenate([[-1], last[:-1]])
                # 0 is what the batches before hold of this key
                place = np.where((prior >= 0) & (prior >= start), prior + 1, np.where(start < 0, 0, -1))
                every = pa.concat_arrays([held, column])
                out[f"_l_{v}"] = every.take(pa.array(place, pa.int64(), mask=place < 0))
                end = last[-1] + 1 if last[-1] >= max(start[-1], 0) else 0 if start[-1] < 0 else -1
                before[v] = every.take(pa.array(np.array([end]), pa.int64(), mask=np.array([end < 0])))
                out[f"_s_{v}"] = pa.concat_arrays([pa.nulls(n - 1, column.type), before[v]])
            for k in keys:
                before[k] = batch.column(k).slice(n - 1)
            if pending is not None:
                yield _marked(pending, False)
            out |= {"_rank": pa.array(rank.astype(np.int64)), "_first": pa.array(ours), "_begin": pa.array((at == 0) & (not begun))}
            pending, begun = out, True
        if pending is not None:
            yield _marked(pending, True)

    return run


def _marked(columns: dict[str, pa.Array], last: bool) -> pa.RecordBatch:
    n = len(columns["_rank"])
    columns["_end"] = pa.array((np.arange(n) == n - 1) & last)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _swept(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], following: bool = False) -> DataFrame:
    """``df`` with ``_rank`` and the ``_l_`` columns over whole keys, whatever partitions they lie in."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_v_{v}" for v in values]
    ranged = df.withColumns(dict(zip(named, values.values()))).repartitionByRange(parts, *keys, *order).withColumn(
        "_piece", F.spark_partition_id() * (-1 if following else 1)).sortWithinPartitions(
        *[(F.desc if following else F.asc)(c) for c in (*keys, *order)])
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    columns = [*df.columns, "_piece", *(c for v in named for c in (f"_l_{v}", f"_s_{v}")), "_rank", "_first", "_begin", "_end"]
    kinds |= {f"_{side}_{v}": kinds[v] for v in named for side in "ls"} | {"_rank": "bigint"} | dict.fromkeys(("_first", "_begin", "_end"), "boolean")
    cut = materialize(ranged.mapInArrow(_sweep(keys, named), ", ".join(f"`{c}` {kinds[c]}" for c in columns)), "swept")
    # a row per end and beginning of a partition: what its last key had so far, asked by the next one with that key
    on = [*keys, "_piece"]
    ends = cut.filter("_end").select(*on, F.lit(1).alias("_at"), (F.col("_rank") + 1).alias("_n"), *(F.col(f"_s_{v}").alias(f"_c_{v}") for v in named))
    heads = cut.filter("_begin").select(*on, F.lit(0).alias("_at"), F.lit(0).cast("long").alias("_n"), *(F.lit(None).cast(kinds[v]).alias(f"_c_{v}") for v in named))
    earlier = Window.partitionBy(*keys).orderBy("_piece", "_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(heads).select(
        "_piece", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        *(F.last(f"_c_{v}", ignorenulls=True).over(earlier).alias(f"_c_{v}") for v in named)).filter("_at = 0").drop("_at")
    # at most one row per partition
    whole = cut.join(F.broadcast(carried.withColumnRenamed("_piece", "_of")), F.col("_piece") == F.col("_of"))
    return whole.withColumns({
        "_rank": F.col("_rank") + F.when(F.col("_first"), F.col("_offset")).otherwise(0),
        **{f"_l_{v}": F.coalesce(f"_l_{v}", F.when(F.col("_first"), F.col(f"_c_{v}"))) for v in named}})


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "position", bounded: bool = False) -> DataFrame:
    """Number the rows of each group from 0; ``order`` must be unique within a group."""
    if bounded:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return _swept(df, keys, order, {}).select(*df.columns, F.col("_rank").alias(out))


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    bounded: bool = False,
    following: bool = False,
) -> DataFrame:
    """Nearest earlier (or following) row's non-null value in each group, one output column per entry of ``values``.

    ``order`` must be unique within a group.
    """
    if bounded:
        window = Window.partitionBy(*keys).orderBy(*[F.desc(c) if following else F.asc(c) for c in order])
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out: F.last(value, ignorenulls=True).over(before) for out, value in values.items()})
    return _swept(df, keys, order, values, following).select(*df.columns, *(F.col(f"_l__v_{out}").alias(out) for out in values))


def with_group_count(df: DataFrame, keys: list[str], out: str = "total") -> DataFrame:
    """Attach the size of each row's group. The counts are a table first: joined with an aggregate as it stands, all rows of
    a key would have to meet in one task, while two plain shuffles can be split."""
    return df.join(materialize(df.groupBy(*keys).agg(F.count("*").alias(out)), "counts"), keys)


def paged_lists(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str = "items",
    page_size: int = 1000,
    bounded: bool = False,
) -> DataFrame:
    """Ordered list of each group in pages of bounded length: no row ever holds a whole hot group."""
    placed = positions(df, keys, order, "_pos", bounded)
    paged = placed.withColumn("page", F.floor(F.col("_pos") / page_size).cast("long"))
    items = F.sort_array(F.collect_list(F.struct(F.col("_pos"), value.alias("item"))))
    return paged.groupBy(*keys, "page").agg(F.transform(items, lambda x: x["item"]).alias(out))
