"""N-gram Jaccard join with Bayesian candidate pruning.

Every text becomes the set of its runs of ``SHINGLE`` words. Texts with the same set are one representative. Candidates
are representatives that share a band of MinHash values; with 32 bands of 4 values a pair at similarity 0.8 has all
bands different once in 20 million. Candidates are compared ``STEP`` values at a time: with m of n values equal, the
similarity has a Beta(m + 1, n - m + 1) posterior under a uniform prior, and a pair goes when the posterior probability
of reaching the threshold is below ``TOLERANCE``. What is left is verified exactly, all pairs of a cluster of candidates
by sums of shared shingles.

Nothing is emitted per pair. A bucket emits the components of its surviving pairs, fewer edges than members, and a
verified cluster emits numbers of links and components. Buckets and clusters are cut into blocks, and each pair of blocks
is a task's work of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import materialize
from .common import NO_ID, Words, chunks, grams, keyed, mixed, prepare, settled, shown_id, signed, stream, table

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS, STEP = 32, 4, 32
TOLERANCE = 1e-6
BLOCK = 256

_A, _B = stream(BANDS * ROWS, 3) | np.uint64(1), stream(BANDS * ROWS, 4)

_SIGNED = pa.schema([
    ("id", pa.int64()), ("rid", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("signature", pa.binary()),
])
_BAND = pa.schema([("key", pa.int64()), ("node", pa.binary())])
_EDGE = pa.schema([("src", pa.binary()), ("dst", pa.binary())])
_FOUND = pa.schema([("src", pa.binary()), ("dst", pa.binary()), ("links", pa.int64())])


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's runs of k words; a text of fewer words has one run, one without words none."""
    words = Words(texts)
    hashes = words.hashes()
    every = grams(hashes, k)
    out = []
    for first, n in zip(words.first.tolist(), words.counts.tolist()):
        if n >= k:
            out.append(np.unique(every[first : first + n - k + 1]))
        else:
            out.append(grams(hashes[first : first + n], n) if n else np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values of 32 bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[start : start + 2048, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs to stay) for each step."""

    def reaches(m: int, n: int) -> float:  # the tail of Beta(m + 1, n - m + 1), a binomial sum for whole parameters
        return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    steps = range(STEP, BANDS * ROWS + 1, STEP)
    return [(n, next(m for m in range(n + 1) if reaches(m, n) >= tolerance)) for n in steps]


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            sets = shingle_sets(texts, k)
            yield table(
                _SIGNED, id=rows.column("id"), rid=rows.column("rid"), size=[len(s) for s in sets],
                node=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                signature=[min_hashes(s).tobytes() if len(s) else b"" for s in sets],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = stream(BANDS, 5)
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        if not nodes:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(nodes), BANDS, ROWS)
        keys = np.broadcast_to(salt, (len(nodes), BANDS)).copy()
        for r in range(ROWS):
            keys = mixed(keys ^ values[:, :, r])
        yield table(_BAND, key=signed(keys.ravel()), node=[n for n in nodes for _ in range(BANDS)])


def in_block_pairs(df: DataFrame, group: str, size: Column, node: str = "node", block: int = BLOCK) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: columns ``one`` <= ``two``, and ``mine``.

    A group of up to ``block`` rows is one pair with itself.
    """
    blocks = F.ceil(size / F.lit(block)).cast("int")
    df = df.withColumn("mine", F.pmod(F.xxhash64(node, group), blocks).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other")).drop("other")


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The groups of rows that come sorted by their keys, one at a time."""
    key, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if now != key:
                if group:
                    yield group
                key, group = now, []
            group.append(row)
    if group:
        yield group


class Forest:
    """Labels of components while edges come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.label[a] != self.label[b]:
                self.label[self.label == self.label[b]] = self.label[a]

    def stars(self, nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each node but the smallest of a component with that one."""
        least: dict[int, bytes] = {}
        for label, node in zip(self.label.tolist(), nodes):
            least[label] = min(node, least.get(label, node))
        return [(node, least[label]) for label, node in zip(self.label.tolist(), nodes) if node != least[label]]


def surviving(signatures: np.ndarray, mine: np.ndarray, same: bool, needed: list[tuple[int, int]]) -> Forest:
    """The components of the pairs that pruning leaves; between two blocks only pairs across them count."""
    n = len(signatures)
    forest = Forest(n)
    for a in range(n):
        others = np.flatnonzero(forest.label != forest.label[a])
        others = others[others > a] if same else others[(others > a) & (mine[others] != mine[a])]
        equal, done = np.zeros(len(others), np.int64), 0
        for upto, least in needed:
            if not len(others):
                break
            equal += (signatures[others, done:upto] == signatures[a, done:upto]).sum(axis=1)
            stay = equal >= least
            others, equal, done = others[stay], equal[stay], upto
        forest.join(a, others)
        if same and (forest.label == forest.label[0]).all():
            break
    return forest


def _prune(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = least_matches(threshold)
        src: list[bytes] = []
        dst: list[bytes] = []
        for group in _by_group(batches, ("key", "one", "two")):
            if len(group) > 1:
                nodes = [g["node"] for g in group]
                signatures = np.frombuffer(b"".join(g["signature"] for g in group), np.uint32).reshape(len(group), -1)
                forest = surviving(signatures, np.array([g["mine"] for g in group]), group[0]["one"] == group[0]["two"], needed)
                edges = forest.stars(nodes)
                src += [a for a, _ in edges]
                dst += [b for _, b in edges]
            if len(src) >= 10_000:
                yield table(_EDGE, src=src, dst=dst)
                src, dst = [], []
        yield table(_EDGE, src=src, dst=dst)

    return run


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many shingles each two sets share. Shingles in one set only share nothing; the rest goes by ``width``."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[where]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for start in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(place, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], place[a:b] - start] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(k: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in _FOUND}
        for group in _by_group(batches, ("label", "one", "two")):
            same = group[0]["one"] == group[0]["two"]
            if len(group) < 2:
                continue
            nodes, mine = [g["node"] for g in group], np.array([g["mine"] for g in group])
            copies = np.array([g["copies"] for g in group])
            sets = shingle_sets([g["text"].encode("utf-8", "surrogatepass") for g in group], k)
            sizes = np.array([len(s) for s in sets])
            shared = shared_counts(sets)
            # shared / (a + b - shared) >= p / q in whole numbers
            p, q = threshold.numerator, threshold.denominator
            linked = (p + q) * shared >= p * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(linked, False)
            if not same:
                linked &= mine[:, None] != mine[None, :]
            forest = Forest(len(group))
            for a in range(len(group)):
                forest.join(a, np.flatnonzero(linked[a]))
            links = linked @ copies
            for a in np.flatnonzero(links).tolist():
                out["src"].append(nodes[a])
                out["dst"].append(None)
                out["links"].append(int(links[a]))
            for a, b in forest.stars(nodes):
                out["src"].append(a)
                out["dst"].append(b)
                out["links"].append(0)
            if len(out["src"]) >= 10_000:
                yield table(_FOUND, **out)
                out = {f.name: [] for f in _FOUND}
        yield table(_FOUND, **out)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                threshold: Fraction = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Classes of documents that links join, links being pairs with a Jaccard similarity of ``threshold`` or more.

    Returns (id_col, class_id, n_links, kept, text_hash), one row per row of ``docs``: the smallest id of the class, the number of
    other rows linked to this one (copies count), and whether this row is the one of its class that stays, that with
    the smallest id. Words are ``[^\\x20\\x09-\\x0D]+``, as they stand. A text of fewer than k words is one run of all
    its words. Null and empty texts have no words and link to nothing. A null id counts as smaller than all others and
    is shown as null; rows with the same id are rows of their own, and rows that are copies as a whole share ``kept``.
    Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    every = materialize(
        rows.mapInArrow(_sign(k), "id long, rid long, node binary, size long, signature binary"), "signatures"
    )
    some = every.filter("size > 0")
    nodes = materialize(some.groupBy("node").agg(
        F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("copies"), F.first("signature").alias("signature")
    ), "representatives")
    bands = nodes.select("node", "signature").mapInArrow(_bands, "key long, node binary")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = in_block_pairs(bands.join(settled(shared, "bands"), "key"), "key", F.col("n"), block=block).drop("n")
    members = members.join(nodes.select("node", "signature"), "node")
    by = ["key", "one", "two"]
    candidates = materialize(
        members.select(*by, "mine", "node", "signature").repartition(*by).sortWithinPartitions(*by)
        .mapInArrow(_prune(float(threshold)), "src binary, dst binary").distinct(), "candidates"
    )
    none = spark.createDataFrame([], "node binary")
    clusters = components(none, candidates, [])
    clusters = materialize(clusters, "clusters")
    sizes = clusters.groupBy("label").agg(F.count("*").alias("n"))
    spread = in_block_pairs(clusters.join(settled(sizes, "sizes"), "label"), "label", F.col("n"), block=block).drop("n")
    # one row with its text per representative, chosen by its keys; copies as a whole have the same text
    texts = rows.join(
        nodes.join(clusters.select("node"), "node", "left_semi").select("node", "copies", "first.id", "first.rid"), ["id", "rid"]
    ).groupBy("node").agg(F.first("copies").alias("copies"), F.first("text").alias("text"))
    by = ["label", "one", "two"]
    found = materialize(
        spread.join(texts, "node").select(*by, "mine", "node", "copies", "text").repartition(*by).sortWithinPartitions(*by)
        .mapInArrow(_verify(k, threshold), "src binary, dst binary, links long"), "links"
    )
    links = found.filter("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(none, found.filter("dst is not null").select("src", "dst"), [])
    placed = nodes.select("node", "first", "copies").join(joined, "node", "left").join(links, "node", "left").select(
        "node", "first", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")
    )
    placed = materialize(placed, "placed")
    least = placed.groupBy("label").agg(F.min("first").alias("least"))
    placed = placed.join(settled(least, "least"), "label").select("node", "least", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = every.select("id", "rid", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(placed, "node", "left")
    own = F.struct("id", "rid")
    return out.select(
        shown_id(id_col), F.nullif(F.coalesce(F.col("least.id"), F.col("id")), F.lit(NO_ID)).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce(F.col("least"), own) == own).alias("kept"), F.col("rid").alias("text_hash"),
    )
