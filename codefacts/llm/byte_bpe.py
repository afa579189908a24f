"""Byte-level BPE with a rank queue in hierarchical bitmaps.

The pairs of neighbouring parts of a pre-token wait in buckets, one per merge rank, that hold the place of the pair's
left part in a linked list. A bitmap of two levels, 256 ranks to a word, says which buckets hold something; finding
the first set bit of each level gives the next rank. Entries whose pair has changed meanwhile are stale and skipped.
A pre-token of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, prepare, shown_id, table
from .pretokens import Memo, splitter, units

#: Fixed: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Kept by one worker: encoded pre-tokens, and stretches of text with the space before them.
PIECES, UNITS = 1_000_000, 300_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


_BIT = [1 << i for i in range(1 << 10)]


class RankQueue:
    """Places by rank; the smallest rank, and in it the leftmost place, comes first.

    Two levels of 256 bits to a word: ``words[r >> 8]`` has bit ``r & 255`` for a bucket that holds something, ``top``
    a bit for each word that is not 0.
    """

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, pairs: list[int | None]) -> None:
        """Put place i in for each rank ``pairs[i]`` into an empty queue."""
        buckets = self.buckets
        for place, rank in enumerate(pairs):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(place)  # ascending places are a heap
                else:
                    buckets[rank] = [place]
        words, top = self.words, 0
        for rank in buckets:
            high = rank >> 8
            words[high] |= _BIT[rank & 255]
            top |= _BIT[high]
        self.top = top

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [place]
            self.words[rank >> 8] |= _BIT[rank & 255]
            self.top |= _BIT[rank >> 8]
        else:
            heappush(bucket, place)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        word = self.words[high]
        low = word & -word
        rank = high << 8 | low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[high] = word ^ low
        if word == low:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Encoder:
    """Encodes as the library of the rank files does: each match of the pattern by itself, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, splitter(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.memo = Memo(self._unit, UNITS)
        self.pieces = Memo(self._packed, PIECES)

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # the linked list: where the next part starts, which is also where this one ends
        before = list(range(-1, n - 1))
        get = ranks.get
        pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        queue = self.queue
        push, pop = queue.push, queue.pop
        queue.fill(pair)
        while (entry := pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            pair[j] = None
            if end < n:
                before[end] = i
                new = pair[i] = get(piece[i : after[end]])
                if new is not None:
                    push(new, i)
            else:
                pair[i] = None
            left = before[i]
            if left >= 0:
                new = pair[left] = get(piece[left:end])
                if new is not None:
                    push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _packed(self, piece: str) -> bytes:
        ids = self.piece(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(unit)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        every = units(text)
        return b"".join(map(self.memo.__getitem__, every)) if len(every) > 1 else self._unit(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[int, Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker process."""
    key = hash((content, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(content), pattern)
    return _encoders[key]


_SCHEMA = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Encode every text by the rank file at ``path`` (read once by the driver, 1 MB) and decode the ids again.

    Returns (id_col, n_tokens, ids, decoded), one row per row of ``docs``; ``ids`` are little-endian unsigned 32-bit
    integers. A null text is an empty one and has no ids. Null and repeated ids and copies are rows like all others;
    other columns are ignored. Nothing is shuffled.
    """
    spark = prepare(docs.sparkSession)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            yield table(
                _SCHEMA, id=batch.column("id"), n_tokens=[len(i) // 4 for i in ids], ids=ids,
                decoded=[encoder.decode(i) for i in ids],
            )

    rows = keyed(docs, id_col, text_col).select("id", "text")
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary").select(
        shown_id(id_col), "n_tokens", "ids", "decoded"
    )
