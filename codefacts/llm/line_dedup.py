"""Line dedup with two Bloom filters.

Each line sends only the hash of its key, with its row's keys, to the task that owns the hash. That task passes the
hashes through two Bloom filters, one of hashes seen once and one of hashes seen twice, and what the second holds is a
suspected repeat. The filters live and die in that task and are sized by its own rows, and there are as many owners as
the lines need. Only rows with suspects are looked up in their texts again, and only their keys are shuffled for the
exact confirmation and the choice of the first document. Which rows these are, and which lose lines in the end, goes to
the tasks as a filter of bounded size, so other texts aren't shuffled; a join decides. A hash that several rows of one batch
share is known to repeat at once: those rows bypass the owner, who gets one row in their place, so a line that a third
of all documents hold sends it one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACES, chunks, keyed, members, mixed, prepare, settled, shown_id, signed, table

LEAST = 10
BITS_PER_HASH = 16
PROBES = 4
PER_OWNER = 4_000_000

_HASHES = pa.schema([("to", pa.int64()), ("kind", pa.int8()), ("hash", pa.int64()), ("id", pa.int64()), ("rid", pa.int64())])
_SUSPECTS = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("hash", pa.int64())])
_KEYS = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("key", pa.binary())])
_KEPT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])
_ONE, _MANY, _KNOWN = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


class Bloom:
    """A Bloom filter for about ``n`` 64-bit hashes."""

    def __init__(self, n: int):
        self.bits = max(6, int(n * BITS_PER_HASH).bit_length())
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        a, b = mixed(hashes), mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) >> np.uint64(64 - self.bits) for i in range(PROBES)])

    def add(self, hashes: np.ndarray) -> None:
        places = self._places(hashes)
        np.bitwise_or.at(self.words, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        places = self._places(hashes)
        bit = self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))
        return (bit & np.uint64(1)).astype(bool).all(axis=0)


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1 << 22):
            doc, hashed = [], []
            for d, text in enumerate(texts):
                own = {k for line in text.split(b"\n") if _long(k := line_key(line), least)}
                doc += [d] * len(own)
                hashed += [xxhash.xxh3_64_intdigest(k) for k in own]
            h, d = np.array(hashed, np.uint64), np.array(doc, np.int64)
            ids, rids = (np.asarray(rows.column(c)) for c in ("id", "rid"))
            values, where, counts = np.unique(h, return_inverse=True, return_counts=True)
            shared = counts[where] > 1
            single, many = ~shared, values[counts > 1]
            none = np.zeros(len(many), np.int64)
            yield table(
                _HASHES,
                to=np.concatenate([signed(h[single]), signed(many), signed(mixed((ids ^ rids).view(np.uint64)))[d[shared]]]),
                kind=np.repeat(np.array([_ONE, _MANY, _KNOWN], np.int8), [single.sum(), len(many), shared.sum()]),
                hash=signed(np.concatenate([h[single], many, h[shared]])),
                id=np.concatenate([ids[d[single]], none, ids[d[shared]]]),
                rid=np.concatenate([rids[d[single]], none, rids[d[shared]]]),
            )

    return run


def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one owner whose hash the second filter holds."""
    held = []
    for batch in batches:
        kind, h, ids, rids = (np.asarray(batch.column(c)) for c in ("kind", "hash", "id", "rid"))
        known = kind == _KNOWN
        if known.any():
            yield table(_SUSPECTS, id=ids[known], rid=rids[known], hash=h[known])
        held.append((kind[~known], h[~known].view(np.uint64), ids[~known], rids[~known]))
    once, twice = Bloom(sum(len(x[1]) for x in held)), Bloom(sum(len(x[1]) for x in held))
    for kind, h, _, _ in held:
        values, counts = np.unique(h, return_counts=True)
        twice.add(np.concatenate([values[counts > 1], values[once.has(values)], h[kind == _MANY]]))
        once.add(values)
    for kind, h, ids, rids in held:
        out = twice.has(h) & (kind == _ONE)
        yield table(_SUSPECTS, id=ids[out], rid=rids[out], hash=signed(h[out]))


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _KEYS}
            for id_, rid, text, hashes in zip(*(batch.column(c).to_pylist() for c in ("id", "rid", "text", "hashes"))):
                wanted = set(hashes)
                for key in {line_key(line) for line in text.encode("utf-8", "surrogatepass").split(b"\n")}:
                    h = xxhash.xxh3_64_intdigest(key)
                    if (h - (1 << 64) if h >> 63 else h) in wanted and _long(key, least):
                        out["id"].append(id_)
                        out["rid"].append(rid)
                        out["key"].append(key)
            yield table(_KEYS, **out)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _KEPT}
        for id_, text, drop in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "drop"))):
            lines, gone = text.encode("utf-8", "surrogatepass").split(b"\n"), set(drop or ())
            left = [line for line in lines if line_key(line) not in gone] if gone else lines
            out["id"].append(id_)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(left))
            out["kept_text"].append(b"\n".join(left).decode("utf-8", "surrogatepass"))
        yield table(_KEPT, **out)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keep(b.append_column("drop", pa.nulls(len(b), pa.list_(pa.binary()))) for b in batches)


def _owned(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    """The hashes dealt to their owners, at most about PER_OWNER lines to each."""
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    owners = -(-lines // PER_OWNER)
    more = owners > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hashes.repartition(owners, "to") if more else hashes.repartition("to")


def repeated_lines(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, rid, key): the lines that each row of ``keyed`` loses, since a row with a smaller id holds them too."""
    hashes = rows.mapInArrow(_hashes(least), "to long, kind byte, hash long, id long, rid long")
    suspects = _owned(hashes, rows).mapInArrow(suspected, "id long, rid long, hash long")
    looked_up = settled(suspects.groupBy("id", "rid").agg(F.collect_set("hash").alias("hashes")), "suspects")
    moved = rows.mapInArrow(members(looked_up.select("id", "rid")).only, "id long, rid long, text string")
    keys = materialize(moved.join(looked_up, ["id", "rid"]).mapInArrow(_keys(least), "id long, rid long, key binary"), "keys")
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    return keys.join(settled(first.select("key", "first"), "first"), "key").filter("id > first").select("id", "rid", "key")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Drop lines whose key at least two documents hold, except in the document with the smallest id that holds it.

    Returns (id_col, n_lines, n_dropped, kept_text), one row per row of ``docs``. A key is the line without white space
    at its ends, A-Z in lower case; keys under ``least`` code points are never dropped. A null or empty text is one
    empty line. A null id counts as smaller than all others. Rows with the same id are one document. Lines that a
    document itself repeats stay. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    drop = settled(repeated_lines(rows, least).groupBy("id", "rid").agg(F.collect_set("key").alias("drop")), "drop")
    some, out = members(drop.select("id", "rid")), "id long, n_lines long, n_dropped long, kept_text string"
    moved = rows.mapInArrow(some.only, "id long, rid long, text string").join(drop, ["id", "rid"], "left").mapInArrow(_keep, out)
    # rows that lose nothing stay where they are read
    kept = moved.unionByName(rows.mapInArrow(lambda batches: _whole(some.only(batches, False)), out))
    return kept.select(shown_id(id_col), "n_lines", "n_dropped", "kept_text")
