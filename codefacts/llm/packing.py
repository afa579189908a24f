"""Packing as a cutting-stock problem, solved by column generation.

A document's ids are cut into full sequences and one remainder, so pieces are known before anything is packed. Sizes of
remainders, rounded up to ``GRAIN`` ids, make a histogram of bounded length. A linear program over packing patterns
covers it with the fewest sequences: its dual prices go into a knapsack over the sizes, the best pattern enters the
basis, and so on until no pattern has a negative reduced cost. Rounded down, the solution leaves a few pieces per size,
which are packed best-fit. Every slot of every pattern has a number, and the remainders of a size, ranked in parts that
need no single task, take the slots in order.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .byte_bpe import PATTERN
from .common import keyed, prepare, shown_id, table
from .pretokens import Memo, units

LENGTH, GRAIN, END = 2048, 4, 1

_PIECES = pa.schema([
    ("id", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of a text by a byte-level BPE file of the tokenizers library.

    Ids of such a file are merge ranks as a rule; then its units are encoded once each by rank. Files for which that
    does not hold, and texts with an added token in them, go through the library itself.
    """

    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        spec = json.loads(content)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(p)] for p in pairs]
        self.ranked = made == sorted(made)
        if self.ranked:
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in set(self.added)}
            self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.memo = Memo(self._unit)

    def _unit(self, unit: str) -> bytes:
        ids = self.fast.encode_ordinary(unit)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if not self.ranked or any(t in text for t in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        every = units(text)
        return b"".join(map(self.memo.__getitem__, every)) if len(every) > 1 else self._unit(text)


_tokens: dict[int, Tokens] = {}


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, rid, start, length, ids_crc32, doc_tokens): full sequences and one remainder of every row of ``keyed``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _tokens:
            _tokens.clear()
            _tokens[key] = Tokens(content.value)
        tokens = _tokens[key]
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for id_, rid, text in zip(*(batch.column(c).to_pylist() for c in ("id", "rid", "text"))):
                ids = tokens.encode(text) + last
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    out["id"].append(id_)
                    out["rid"].append(rid)
                    out["start"].append(start)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(total)
            yield table(_PIECES, **out)

    return docs.mapInArrow(run, "id long, rid long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The knapsack: sizes 1 … capacity at these prices (index 0 unused), with repetition; its value and counts."""
    value, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        offers = value[w - 1 :: -1] + prices[1 : w + 1]
        s = int(offers.argmax())
        if offers[s] > value[w - 1] + 1e-15:
            value[w], taken[w] = offers[s], s + 1
        else:
            value[w] = value[w - 1]
    counts: dict[int, int] = {}
    w = capacity
    while w > 0:
        s = int(taken[w])
        if s:
            counts[s] = counts.get(s, 0) + 1
        w -= s or 1
    return float(value[capacity]), counts


def greedy_basis(demand: dict[int, int], capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """First-fit-decreasing in fractions: each pattern is filled from the largest sizes left and used until one is gone.

    With the patterns in the order of the sizes they use up, the matrix is triangular: a feasible basis.
    """
    sizes = sorted((s for s, d in demand.items() if d), reverse=True)
    left = {s: float(demand[s]) for s in sizes}
    patterns, uses = {}, {}
    while left:
        pattern, room = {}, capacity
        for s in left:
            if s <= room:
                pattern[s] = room // s
                room -= pattern[s] * s
        gone = min(pattern, key=lambda s: left[s] / pattern[s])
        uses[gone] = left[gone] / pattern[gone]
        patterns[gone] = pattern
        for s, c in pattern.items():
            left[s] = max(0.0, left[s] - c * uses[gone])
        del left[gone]
    return [patterns[s] for s in reversed(sizes)], np.array([uses[s] for s in reversed(sizes)])


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchanges; small, and without a linear algebra library's threads."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for j in range(n):
        k = j + int(np.abs(work[j:, j]).argmax())
        if k != j:
            work[[j, k]] = work[[k, j]]
        work[j] /= work[j, j]
        others = np.flatnonzero(work[:, j])
        others = others[others != j]
        work[others] -= work[others, j, None] * work[j]
    return work[:, n:]


def column_generation(demand: dict[int, int], capacity: int, gap: float = 5e-4, rounds: int = 500) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, in the linear relaxation. ``demand``: pieces by size, 1 … capacity.

    Stops when the dual bound shows that no solution uses ``gap`` less. Any basis covers the demand, so stopping after
    ``rounds`` costs padding and nothing else.
    """
    sizes = sorted(s for s, d in demand.items() if d)
    row = {s: i for i, s in enumerate(sizes)}
    d = np.array([demand[s] for s in sizes], float)
    patterns, x = greedy_basis(demand, capacity)

    def column(p: dict[int, int]) -> np.ndarray:
        return np.bincount([row[s] for s in p], weights=list(p.values()), minlength=len(sizes))

    inverse = inverted(np.stack([column(p) for p in patterns], axis=1))
    bound = sum(s * n for s, n in demand.items()) / capacity
    for k in range(1, rounds + 1):
        prices = np.zeros(capacity + 1)
        prices[sizes] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices, capacity)
        bound = max(bound, x.sum() / value)
        if x.sum() <= bound * (1 + gap):
            break
        enter = (inverse * column(pattern)).sum(axis=1)
        ratio = np.full(len(x), np.inf)
        able = enter > 1e-9
        ratio[able] = np.maximum(x[able], 0) / enter[able]
        out = int(ratio.argmin())
        x = x - ratio[out] * enter
        x[out] = ratio[out]
        patterns[out] = pattern
        pivot = inverse[out] / enter[out]
        inverse -= np.outer(enter, pivot)
        inverse[out] = pivot
        if k % 256 == 0:  # against rounding errors
            inverse = inverted(np.stack([column(p) for p in patterns], axis=1))
            x = (inverse * d).sum(axis=1)
    return [(p, max(0.0, float(n))) for p, n in zip(patterns, x)]


def best_fit(pieces: list[int], capacity: int) -> list[dict[int, int]]:
    """Bins for a list of sizes, largest first, each into the fullest bin that has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[dict[int, int]] = []
    for s in sorted(pieces, reverse=True):
        room = next((r for r in range(s, capacity) if rooms[r]), capacity)
        if room == capacity:
            bins.append({})
            b = len(bins) - 1
        else:
            b = rooms[room].pop()
        bins[b][s] = bins[b].get(s, 0) + 1
        rooms[room - s].append(b)
    return bins


def whole_patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole numbers of uses that hold every piece exactly once."""
    left = dict(demand)
    used: list[tuple[dict[int, int], int]] = []
    for pattern, n in column_generation(demand, capacity) if any(demand.values()) else []:
        times = min([int(n + 1e-9), *(left[s] // c for s, c in pattern.items())])
        if times > 0:
            used.append((pattern, times))
            for s, c in pattern.items():
                left[s] -= c * times
    rest = [s for s, n in left.items() for _ in range(n)]
    return used + [(b, 1) for b in best_fit(rest, capacity)]


def slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first slot, slot after the last, first sequence, slots per sequence) of each pattern and size in it."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        for s, c in sorted(pattern.items()):
            start = taken.get(s, 0)
            taken[s] = start + c * times
            out.append((s, start, taken[s], sequence, c))
        sequence += times
    return out, sequence


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end: int = END, grain: int = GRAIN) -> DataFrame:
    """Pack the ids of all texts, each followed by id ``end``, into sequences of at most ``length`` ids.

    Returns one row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length). A
    null or empty text is the id ``end`` alone. Rows with null or repeated ids are packed like all others, and copies
    are packed as often as they occur; other columns are ignored. ``padded_length`` is that of the piece's sequence: a
    power of two stays as it is, any other becomes ``length``.
    """
    spark = prepare(docs.sparkSession)
    pieces = materialize(token_pieces(keyed(docs, id_col, text_col), path, length, end), "pieces")
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = pieces.withColumn("size", F.when(F.col("length") == length, 0).otherwise(F.ceil(F.col("length") / grain)).cast("int")) \
        .withColumn("salt", F.pmod(F.xxhash64("id", "rid", "start"), F.lit(salts)).cast("int"))
    counts = sized.groupBy("size", "salt").agg(F.count("*").alias("pieces"))
    # one number per size: length / grain rows at most
    demand = {r["size"]: r["pieces"] for r in counts.groupBy("size").agg(F.sum("pieces").alias("pieces")).collect()}
    demand.pop(0, None)
    places, sequences = slots(whole_patterns(demand, length // grain))
    before = counts.withColumn(
        "before", F.sum("pieces").over(Window.partitionBy("size").orderBy("salt")) - F.col("pieces")
    ).drop("pieces")
    ranked = sized.withColumn(
        "own", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "start", "rid", "length")) - 1
    ).join(before, ["size", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    # at most one row per pattern and size in it, both bounded by length / grain
    plan = spark.createDataFrame(places, "size int, low long, high long, sequence long, each long")
    placed = ranked.filter("size > 0").join(
        F.broadcast(plan).withColumnRenamed("size", "psize"),
        (F.col("size") == F.col("psize")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("long"))
    inside = Window.partitionBy("sequence_id")
    order = inside.orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")) \
        .withColumn("filled", F.sum("length").over(inside))
    full = ranked.filter("size = 0").withColumn("sequence_id", F.lit(sequences) + F.col("rank")) \
        .withColumn("offset", F.lit(0).cast("long")).withColumn("filled", F.col("length"))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled"]
    out = placed.select(columns).unionByName(full.select(columns))
    power = F.expr("bit_count(filled) = 1")
    return out.select(
        shown_id(id_col), *columns[1:-1], F.when(power, F.col("filled")).otherwise(F.lit(length)).cast("long").alias("padded_length")
    )
