"""Substring dedup by prefix-partitioned suffix trees.

A suffix here starts at a word and is cut after ``window`` words, the depth that matters. Its *prefix* runs up to the
end of its anchor: of the runs of ``PREFIX`` words in the window the one with the smallest hash, the first of equals.
Equal windows have equal prefixes, so suffixes of one anchor make up the subtrees of one group, and neighbouring
suffixes, which mostly share their anchor, travel together as one piece of text. Groups whose anchor is found only once
have no repeats and are dropped before any text moves. In each group the subtree is built over its sorted suffixes;
its internal nodes at full depth are the repeats, and neighbouring ones join to maximal repeats. A group with more than
``group`` pieces is split by longer prefixes: first by the whole piece, so that equal pieces become one row before any
shuffle and all their windows are repeats at once, and what is left of it by the whole window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Words, chunks, grams, keyed, prepare, settled, shown_id, signed, table

PREFIX = 8
GROUP = 512
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_RUNS = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("anchor", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
_PIECES = pa.schema([
    ("big", pa.bool_()), ("key", pa.binary()), ("id", pa.int64()), ("rid", pa.int64()), ("first", pa.int32()),
    ("n", pa.int32()), ("body", pa.binary()),
])
_WINDOWS = pa.schema([("window", pa.binary()), ("id", pa.int64()), ("rid", pa.int64()), ("first", pa.int32())])
_FOUND = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])


def anchored_runs(words: Words, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, number of windows) of the runs of windows that share an anchor."""
    hashes, total = words.hashes(), len(words.starts)
    if total < window:
        return (np.zeros(0, np.int64),) * 4
    gram = grams(hashes, prefix)
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span, have = window - prefix + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    n = total - window + 1
    at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(at) != 1)]))
    ends = np.concatenate([new[1:], [len(at)]])
    return words.doc[at[new]], signed(gram[anchor[new]]), at[new] - words.first[words.doc[at[new]]], ends - new


def _runs(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, anchor, first, n = anchored_runs(Words(texts), window, prefix)
            ids, rids = (np.asarray(rows.column(c)) for c in ("id", "rid"))
            yield table(_RUNS, id=ids[doc], rid=rids[doc], anchor=anchor, first=first, n=n)

    return run


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _pieces(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for id_, rid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "rid", "text", "runs"))):
                words = _WORD.findall(text.encode("utf-8", "surrogatepass"))
                for r in runs:
                    first, n = r["first"], r["n"]
                    body = b" ".join(words[first : first + n + window - 1])
                    out["big"].append(r["big"])
                    out["key"].append(_digest(body) if r["big"] else r["anchor"].to_bytes(8, "big", signed=True))
                    out["id"].append(id_)
                    out["rid"].append(rid)
                    out["first"].append(first)
                    out["n"].append(n)
                    out["body"].append(body)
                if len(out["key"]) >= 20_000:
                    yield table(_PIECES, **out)
                    out = {f.name: [] for f in _PIECES}
            yield table(_PIECES, **out)

    return cut


def deep_nodes(bodies: list[bytes], window: int) -> list[tuple[int, int]]:
    """(body, offset) of every suffix below an internal node at depth ``window`` of the suffix tree of these bodies."""
    leaves = []
    for b, body in enumerate(bodies):
        starts = [0, *(m.end() for m in re.finditer(b" ", body))]
        ends = [*starts[window:], len(body) + 1]
        leaves += [(body[s : e - 1], b, i) for i, (s, e) in enumerate(zip(starts, ends))]
    leaves.sort()
    found = []
    for k, (text, b, i) in enumerate(leaves):
        if k and leaves[k - 1][0] == text or k + 1 < len(leaves) and leaves[k + 1][0] == text:
            found.append((b, i))
    return found


def _split(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of a piece; those of pieces that are repeats already have no place."""
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _WINDOWS}
            for row in batch.to_pylist():
                words = row["body"].split(b" ")
                for i in range(len(words) - window + 1):
                    out["window"].append(_digest(b" ".join(words[i : i + window])))
                    out["id"].append(row["id"])
                    out["rid"].append(row["rid"])
                    out["first"].append(row["first"] + i if row["copies"] == 1 else None)
            yield table(_WINDOWS, **out)

    return windows


def maximal(starts: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, how many)."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


def _trees(window: int):
    def subtree(group: list[dict]) -> list[tuple[int, int, int, int]]:
        hits: dict[tuple[int, int], list[int]] = {}
        for b, i in deep_nodes([g["body"] for g in group], window):
            hits.setdefault((group[b]["id"], group[b]["rid"]), []).append(group[b]["first"] + i)
        return [(*key, *run) for key, starts in hits.items() for run in maximal(list(set(starts)))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key, so one group at a time is in memory."""
        key, group = None, []
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    found += subtree(group) if len(group) > 0 else []
                    key, group = row["key"], []
                group.append(row)
            if found:
                yield table(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*found)))))
        if found := subtree(group) if group else []:
            yield table(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*found)))))

    return build


def repeated_windows(docs: DataFrame, window: int = 35, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(id, rid, first, n): windows first … first + n - 1 of a row of ``keyed`` also start somewhere else."""
    runs = docs.mapInArrow(_runs(window, min(prefix, window)), "id long, rid long, anchor long, first int, n int")
    repeated = runs.groupBy("anchor").agg(F.count("*").alias("pieces")).filter("pieces > 1")
    suspects = runs.join(settled(repeated, "anchors"), "anchor").groupBy("id", "rid").agg(
        F.sort_array(F.collect_set(F.struct("first", "n", "anchor", (F.col("pieces") > group).alias("big")))).alias("runs")
    )
    pieces = materialize(docs.join(suspects, ["id", "rid"]).mapInArrow(
        _pieces(window), "big boolean, key binary, id long, rid long, first int, n int, body binary"
    ), "suffixes")
    small = pieces.filter("not big").select("key", "id", "rid", "first", "body")
    trees = small.repartition("key").sortWithinPartitions("key").mapInArrow(
        _trees(window), "id long, rid long, first int, n int"
    )
    big = pieces.filter("big").drop("big")
    alike = materialize(big.groupBy("key").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "rid", "first")).alias("at"), F.first("body").alias("body")
    ).select("key", "copies", "at.*", "body"), "pieces")
    whole = big.join(alike.filter("copies > 1").select("key"), "key").select("id", "rid", "first", "n")
    parts = alike.select("copies", "id", "rid", "first", "body").mapInArrow(
        _split(window), "window binary, id long, rid long, first int"
    )
    often = parts.groupBy("window").count().filter("count > 1").select("window")
    single = parts.filter("first is not null").join(settled(often, "windows"), "window").select("id", "rid", "first", F.lit(1).alias("n"))
    return trees.unionByName(whole).unionByName(single)


def _kept(window: int):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for id_, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "found"))):
                words = _WORD.findall(text.encode("utf-8", "surrogatepass"))
                total, done, left = len(words), 0, []
                for r in sorted(found or [], key=lambda r: r["first"]):
                    left += words[done : max(done, r["first"])]
                    done = max(done, r["first"] + r["n"] + window - 1)
                left += words[done:]
                out["id"].append(id_)
                out["n_words"].append(total)
                out["n_removed"].append(total - len(left))
                out["kept_text"].append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield table(schema, **out)

    return keep


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                   prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose words also start anywhere else.

    Returns (id_col, n_words, n_removed, kept_text), one row per row of ``docs``. A null or empty text has no words, a
    text of fewer words than a window loses nothing. Rows with a null or repeated id are rows like all others, and two
    equal rows repeat each other. Other columns are ignored. Equality is that of the words themselves in the subtrees;
    in groups that are split it is that of 128-bit digests.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(rows, window, prefix, group).groupBy("id", "rid").agg(
        F.collect_set(F.struct("first", "n")).alias("found")
    )
    kept = rows.join(found, ["id", "rid"], "left").mapInArrow(
        _kept(window), "id long, n_words long, n_removed long, kept_text string"
    )
    return kept.select(shown_id(id_col), "n_words", "n_removed", "kept_text")
