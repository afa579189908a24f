"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, to the node that holds what is left after as many whole tokens
as possible are taken from the front of the node's text, and the number of tokens popped on the way, both computed once.
Reading a byte follows trie edges or failure links and adds the popped counts, so a text's greedy longest-match length
takes time linear in its bytes and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import PATTERN, read_ranks
from .common import keyed, prepare, shown_id, table
from .pretokens import Memo, splitter, units


class Automaton:
    """Counts greedy longest-match pieces of byte strings. A byte that starts no token is one unknown piece."""

    def __init__(self, vocabulary):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                child = self.edges[node].get(byte)
                if child is None:
                    child = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = child
            final[node] = bool(token)
        for byte in range(256):  # bytes without a token: nodes of their own that pop one unknown piece
            if byte not in self.edges[0]:
                self.edges[0][byte] = len(self.edges)
                self.edges.append({})
                final.append(True)
            elif not final[self.edges[0][byte]]:
                final[self.edges[0][byte]] = True
        self._link(final)

    def _link(self, final: list[bool]) -> None:
        """failure[v], popped[v]: taking the longest token off v's text, and then all that follow, leaves failure[v]."""
        self.failure: list[int] = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        order = [0]
        for node in order:
            for byte, child in self.edges[node].items():
                if final[child]:
                    self.failure[child], self.popped[child] = 0, 1
                else:
                    at, popped = self.failure[node], self.popped[node]
                    while at >= 0 and byte not in self.edges[at]:
                        popped += self.popped[at]
                        at = self.failure[at]
                    if at >= 0:
                        self.failure[child], self.popped[child] = self.edges[at][byte], popped
                order.append(child)

    def count(self, data: bytes) -> int:
        edges, failure, popped = self.edges, self.failure, self.popped
        node = total = 0
        for byte in data:
            while (child := edges[node].get(byte)) is None:
                total += popped[node]
                node = failure[node]
            node = child
        while node:
            total += popped[node]
            node = failure[node]
        return total


class Counter:
    def __init__(self, vocabulary, pattern: str):
        self.automaton, self.find = Automaton(vocabulary), splitter(pattern).findall
        self.memo = Memo(self._unit)

    def _unit(self, unit: str) -> tuple[int, int]:
        pieces = self.find(unit)
        return len(pieces), sum(self.automaton.count(p.encode("utf-8", "surrogatepass")) for p in pieces)

    def count(self, text: str) -> tuple[int, int]:
        every = units(text)
        if len(every) == 1:
            return self._unit(text)
        found = [self.memo[u] for u in every]
        return sum(f[0] for f in found), sum(f[1] for f in found)


_counters: dict[int, Counter] = {}
_SCHEMA = pa.schema([("id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """The number of greedy longest-match tokens of each text under the vocabulary of the rank file at ``path``.

    Each match of ``pattern`` is cut by itself, always taking the longest token that fits. Returns (id_col, n_pretokens,
    n_tokens, n_bytes), one row per row of ``docs``; null and empty texts have 0 of each. Null and repeated ids and
    copies are rows like all others; other columns are ignored. Nothing is shuffled.
    """
    spark = prepare(docs.sparkSession)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((content.value, pattern))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(read_ranks(content.value), pattern)
        counter = _counters[key]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [counter.count(t) for t in texts]
            yield table(
                _SCHEMA, id=batch.column("id"), n_pretokens=[c[0] for c in counts], n_tokens=[c[1] for c in counts],
                n_bytes=[len(t.encode("utf-8", "surrogatepass")) for t in texts],
            )

    rows = keyed(docs, id_col, text_col).select("id", "text")
    return rows.mapInArrow(run, "id long, n_pretokens long, n_tokens long, n_bytes long").select(
        shown_id(id_col), "n_pretokens", "n_tokens", "n_bytes"
    )
