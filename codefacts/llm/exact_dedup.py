"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes has ``CUT_BITS`` zero bits, so equal texts have equal chunks. The
first pass moves one digest of the list of chunk hashes per row; rows whose digest nobody shares are done, but for those
few that a Bloom filter of the others finds as well: nobody shares their lists either. The texts of the others move once,
as chunks, and rows that are whole copies become one before: equal chunks become one, compared byte by byte, and get an identifier (their hash and,
should two different chunks share it, their place among these). Texts are equal when the ordered lists of identifiers
are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Members, NO_ID, chunks, keyed, members, powers, prepare, settled, shown_id, stream, table

CUT_BITS = 12
LEAST, MOST = 1 << 10, 1 << 16
WIDTH = 32

_GEAR = stream(256, 2)
_RECIPES = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("recipe", pa.binary()), ("text_sha256", pa.string())])
_CHUNKS = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("seq", pa.int32()), ("hash", pa.int64()), ("body", pa.binary())])


def cut(data: bytes) -> list[bytes]:
    """The chunks of a text; no chunk is over MOST bytes, and only the last may be under LEAST."""
    if len(data) <= LEAST:
        return [data]
    raw = np.frombuffer(data, np.uint8)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_GEAR[raw] * up[: len(raw)], dtype=np.uint64)])
    rolling = (sums[WIDTH:] - sums[:-WIDTH]) * down[: len(sums) - WIDTH]
    cuts = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + WIDTH
    out, start = [], 0
    for end in [*cuts.tolist(), len(data)]:
        while end - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if end - start >= LEAST or end == len(data):
            out.append(data[start:end])
            start = end
    return [c for c in out if c] or [b""]


def _normal(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        texts = [_normal(t) for t in texts]
        yield table(
            _RECIPES, id=rows.column("id"), rid=rows.column("rid"),
            recipe=[hashlib.blake2b(b"".join(xxhash.xxh3_64_digest(c) for c in cut(t)), digest_size=16).digest() for t in texts],
            text_sha256=[hashlib.sha256(t).hexdigest() for t in texts],
        )


def _chunks(suspects: Members):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(suspects.only(batches)):
            out: dict[str, list] = {f.name: [] for f in _CHUNKS}
            for id_, rid, text in zip(rows.column("id").to_pylist(), rows.column("rid").to_pylist(), texts):
                for seq, body in enumerate(cut(_normal(text))):
                    out["id"].append(id_)
                    out["rid"].append(rid)
                    out["seq"].append(seq)
                    out["hash"].append(int.from_bytes(xxhash.xxh3_64_digest(body), "big", signed=True))
                    out["body"].append(body)
            yield table(_CHUNKS, **out)

    return run


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of equal texts that each row is in.

    Returns (id_col, keep_id, group_size, kept, text_sha256, text_hash), one row per row of ``docs``; ``text_hash`` is the
    row's own as ``common.only_rows`` takes it. Texts are equal when they are
    identical after A-Z are put in lower case; a null text is an empty one. Of a group the row with the largest id
    stays; a null id is smaller than all others, and of rows with that id and equal texts one stays. ``text_sha256`` is
    that of the text in lower case. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    recipes = materialize(
        rows.mapInArrow(_recipes, "id long, rid long, recipe binary, text_sha256 string"), "recipes"
    )
    shared = recipes.groupBy("recipe").count().filter("count > 1").select("recipe")
    suspects = settled(recipes.join(settled(shared, "shared"), "recipe").select("id", "rid").distinct(), "suspects")
    moved = rows.mapInArrow(_chunks(members(suspects)), "id long, rid long, seq int, hash long, body binary")
    # rows that are copies as a whole need to be compared once only
    pieces = materialize(moved.dropDuplicates(["id", "rid", "seq"]), "chunks")
    contents = pieces.groupBy("hash", "body").agg(F.lit(1))
    place = Window.partitionBy("hash").orderBy("body")
    clashes = contents.select("hash", "body", F.row_number().over(place).alias("place")).filter("place > 1")
    lists = (
        pieces.join(settled(clashes, "clashes"), ["hash", "body"], "left")
        .groupBy("id", "rid")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "hash", F.coalesce("place", F.lit(1)).alias("place")))).alias("list"))
    )
    listed = materialize(recipes.select("id", "rid").join(lists, ["id", "rid"]), "members")
    groups = listed.groupBy("list").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    found = listed.join(settled(groups, "groups"), "list").select("id", "rid", "keep", "size").distinct()
    copy = Window.partitionBy("id", "text_sha256").orderBy("rid")
    out = recipes.join(found, ["id", "rid"], "left").select(
        "id", "rid", "text_sha256", F.coalesce("keep", "id").alias("keep"), F.coalesce("size", F.lit(1)).alias("group_size"),
        F.row_number().over(copy).alias("nth"),
    )
    return out.select(
        shown_id(id_col), F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"), "group_size",
        ((F.col("id") == F.col("keep")) & (F.col("nth") == 1)).alias("kept"), "text_sha256",
        F.col("rid").alias("text_hash"),
    )
