"""What the parts around a part say, by one sweep over the parts of each file in order, with a stack.

A row per part and enclosing part would grow with the square of the nesting depth. Spark sorts whole files into partitions; the
sweeps hold one file at a time, look at a few columns and add to each row what its enclosing parts decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TARGET = pa.struct([("node", pa.int64()), ("catches", pa.list_(pa.int64()))])
GOAL = pa.struct([("to", TARGET), ("label", pa.string())])
LOOPS = ("while", "for")


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables that end where a file ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("file_id").to_pylist()
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if not cut and held and held[-1].column("file_id")[-1].as_py() == ids[0]:
            held.append(batch)  # one file so far
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _swept(rows: DataFrame, order: list[str], sweep: Callable[[pa.Table], pa.Table], added: str) -> DataFrame:
    """Rows of whole files, hashed by file id (see ``lexer.by_file``), through a sweep that adds columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_files(batches):
            yield from sweep(table).to_batches()

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
    return rows.sortWithinPartitions("file_id", *order).mapInArrow(run, schema)


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


def _lent(stack: list, level: int, since: int) -> list[int]:
    """Catches of the tries from a part on that are around a level, outermost first."""
    return [c for e in stack[: max(level, 0)] if e and e[0] >= since and e[1] == "try" for c in e[2]]


def _entries(table: pa.Table) -> pa.Table:
    kept: list[int] = []
    entry: list[dict] = []
    file: object = _entries
    stack: list[tuple | None] = []
    waiting: dict[int, list[tuple[int, int]]] = {}
    seen = None
    for i, (owner, method, ord_, level, kind, node, is_node, catches) in enumerate(_columns(
            table, "file_id", "method_ord", "ord", "level", "kind", "node", "is_node", "catches")):
        if owner != file:
            file, stack, waiting, seen = owner, [], {}, None
        if ord_ != seen:
            seen = ord_
            if is_node:
                for at, since in waiting.pop(method, ()):
                    entry[at] = {"node": node, "catches": _lent(stack, level, since)}
                entry.append({"node": node, "catches": catches if kind == "try" else []})
            else:
                waiting.setdefault(method, []).append((len(entry), ord_))
                entry.append({"node": None, "catches": None})
            kept.append(i)
        if level >= 0:
            stack += [None] * (level + 1 - len(stack))
            stack[level] = (ord_, kind, catches)
    return table.take(pa.array(kept, pa.int64())).append_column("entry", pa.array(entry, TARGET))


def entries(rows: DataFrame) -> DataFrame:
    """Each part once (of those with one id the first), with ``entry``: the node control meets first at a part, which is its own or the next one's, and the
    catches of the tries passed on the way down to it."""
    return _swept(rows, ["ord", "chain", "filled", "node"], _entries, "entry struct<node:bigint,catches:array<bigint>>")


def _goal(node: int, label: str) -> dict:
    return {"to": {"node": node, "catches": []}, "label": label}


def _decision(part: tuple, parent: tuple | None) -> dict | None:
    """Where control goes after a part, if that part or the loop right around it says so."""
    _, kind, _, following, last = part
    if last is not None and kind in ("try", "catch"):
        return _goal(last, "")
    if following is not None:
        return {"to": following, "label": ""}
    return _goal(parent[2], "loop") if parent is not None and parent[1] in LOOPS else None


def _follows(table: pa.Table, leave: int) -> pa.Table:
    follow: list[dict] = []
    parent_node: list[int | None] = []
    file: object = _follows
    method_now = None
    stack: list[tuple | None] = []
    outside = (None, _goal(leave, ""))
    around = [outside]  # per level, the nearest part around and where control goes after that; what a new part changes is dropped
    for owner, method, ord_, level, kind, node, following, last in _columns(
            table, "file_id", "method_ord", "ord", "level", "kind", "node", "next", "finally"):
        if owner != file:
            file, stack, around = owner, [], [outside]
        if method != method_now:
            method_now, around = method, [outside]
        above = max(level, 0)
        stack += [None] * (above - len(stack))
        while len(around) <= above:
            part, (parent, goal) = stack[len(around) - 1], around[-1]
            if part is not None and part[0] > method:
                around.append((part, _decision(part, parent) or goal))
            else:
                around.append((parent, goal))
        own = (ord_, kind, node, following, last)
        parent, goal = around[above]
        follow.append(_decision(own, parent) or goal)
        parent_node.append(None if parent is None else parent[2])
        if level >= 0:
            if len(stack) == level:
                stack.append(None)
            stack[level] = own
            del around[level + 1 :]
    return table.append_column("follow", pa.array(follow, GOAL)).append_column("parent_node", pa.array(parent_node, pa.int64()))


def follows(rows: DataFrame, leave: int) -> DataFrame:
    """``follow``: where control goes after a part, by itself or the nearest enclosing part that decides, and else ``leave``;
    ``parent_node``: the node of the part right around it in its method."""
    return _swept(rows, ["ord"], lambda table: _follows(table, leave),
                  "follow struct<to:struct<node:bigint,catches:array<bigint>>,label:string>, parent_node bigint")
