"""Conversations: slices, lineage, assembled answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.text import icontains, truncate_marked
from .ordering import differs, neighbour, paged_lists, positions, with_group_count

MAX_RESULTS = 50  # fixed value: longest slice
MAX_CONTENT = 500  # fixed value: characters of a shortened message


def slice_messages(
    messages: DataFrame,
    role: str | None = None,
    query: str | None = None,
    start: int = 1,
    limit: int = 10,
    full_content: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Slice of each thread ``(thread, turn, role, content)`` by position among the rows the filters keep.

    ``start`` counts from 1, or from the end when negative; 0 is past the end. Positions and totals refer to the
    filtered thread.
    """
    limit = max(1, min(limit, MAX_RESULTS))
    kept = messages.filter(icontains(F.col("content"), query))
    if role is not None:
        kept = kept.filter(F.col("role") == role)
    totals = with_group_count(positions(kept, ["thread"], ["turn"], "_at", bounded), ["thread"], "total")
    first = F.lit(start - 1) if start >= 1 else F.greatest(F.col("total") + start, F.lit(0))
    inside = (F.col("_at") >= first) & (F.col("_at") < first + limit)
    content = F.col("content") if full_content else truncate_marked(F.col("content"), MAX_CONTENT)
    return totals.filter(inside).select(
        "thread", (F.col("_at") + 1).alias("position"), "total", "role", content.alias("content")
    )


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a given order: partial minima, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, "_r.*").select(*df.columns)
    )


def split_reasoning(
    segments: DataFrame, page_size: int = 10_000, bounded: bool = False
) -> DataFrame:
    """Final answer of each message ``(message, seq, type, content)``: the texts after its last tool segment.

    Segments up to the last tool count as reasoning. A message without a tool keeps all its texts. An answer of more
    than ``page_size`` segments continues on further pages, so no task holds one without end.
    """
    last = segments.groupBy("message").agg(F.max(F.when(F.col("type") == "tool", F.col("seq"))).alias("last_tool"))
    after = segments.join(last, "message").withColumn(
        "reasoning", F.coalesce(F.col("seq") <= F.col("last_tool"), F.lit(False))
    )
    texts = after.filter(~F.col("reasoning") & (F.col("type") == "text")).select("message", "seq", "content")
    pages = paged_lists(texts, ["message"], ["seq"], F.col("content"), "texts", page_size, bounded)
    counts = after.groupBy("message").agg(F.count_if("reasoning").alias("reasoning_segments"))
    return counts.join(pages, "message", "left").select(
        "message", F.coalesce("page", F.lit(0)).alias("page"), "reasoning_segments",
        F.coalesce(F.array_join("texts", ""), F.lit("")).alias("content"),
    )


def turn_lineage(turns: DataFrame, bounded: bool = False) -> DataFrame:
    """Checkpoint of the previous turn of the thread, null for the first: ``(thread, turn, checkpoint_id)``."""
    return neighbour(turns, ["thread"], ["turn"], {"parent_checkpoint_id": F.col("checkpoint_id")}, bounded)


def branch_points(lineage: DataFrame) -> DataFrame:
    """Checkpoints that more than one turn continues."""
    return (
        lineage.groupBy("thread", "parent_checkpoint_id").agg(F.countDistinct("checkpoint_id").alias("branches"))
        .filter("branches > 1")
    )


def _packed(keys: list[str], order: str, text: str):
    """Neighbouring rows of one key as one row with two lists, within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                column = batch.column(k)
                new[1:] |= differs(column.slice(0, n - 1), column.slice(1))
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, n), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in (order, text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in keys), *lists], [*keys, "_orders", "_texts"])

    return run


def assemble_messages(tokens: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Join the streamed pieces of each message in order. A group is one message, as long as its own text.

    Pieces that arrive side by side travel as lists: a row per piece would take many times its text in sorts and shuffles.
    """
    rows = tokens.select(*keys, order, text)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([*(StructField(k, kinds[k]) for k in keys), StructField("_orders", ArrayType(kinds[order])), StructField("_texts", ArrayType(kinds[text]))])
    packed = rows.mapInArrow(_packed(keys, order, text), schema)
    lists = packed.groupBy(*keys).agg(F.collect_list(F.struct("_orders", "_texts")).alias("_lists"))
    zipped = F.transform("_lists", lambda x: F.zip_with(x["_orders"], x["_texts"], lambda o, t: F.struct(o.alias("o"), t.alias("t"))))
    pieces = lists.select(*keys, F.sort_array(F.flatten(zipped)).alias("_pieces"))
    return pieces.select(
        *keys, F.array_join(F.transform("_pieces", lambda p: p["t"]), "").alias("content"), F.size("_pieces").cast("long").alias("pieces"))


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per tool call ``(thread, turn, call_id, seq, tool, status)``: its tool and its latest status."""
    return events.groupBy("thread", "turn", "call_id").agg(
        F.min("seq").alias("started_seq"), F.min_by("tool", "seq").alias("tool"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
    )


def ordered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A listing in a stable order; the last column breaks ties."""
    return df.orderBy(*columns)
