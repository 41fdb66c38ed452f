"""Deeply nested JSON shredded into level columns, and flat tables assembled from them.

Every leaf path becomes a column of (repetition level, definition level, value) entries. The
repetition level tells at which list of the path a new element begins, the definition level how
much of the path is there. What stands where is then read off the levels alone: the position of an
element, and of every element that holds it, is a running count over its column. A list has a
column of its own, so that null elements and empty lists keep their place. No row leaves its task.

Levels of definition, from the record (0) downwards: a key that is there and not null is one more;
a value that is a list is one more, an element's place in it one more, an element that is not null
one more; a scalar is one more than the place it stands at.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.runtime import slices

@dataclass(frozen=True)
class Repeated:
    """A list field that may stand anywhere in a record, and the list inside its elements (``child``), if any.

    With ``bare_lists`` an element that is itself a list stands for its child list.
    """

    name: str
    child: str | None = None
    bare_lists: bool = False


@dataclass(frozen=True)
class Single:
    """A scalar ``name`` inside every object ``holder``, wherever that stands."""

    holder: str
    name: str


#: Lists and scalars of an annotation record that become child tables.
RECORD_FIELDS = (
    Single("tier_0_classification", "content_type"),
    Repeated("step_by_step", "sub_steps", bare_lists=True),
    Repeated("common_mistakes"),
    Repeated("formulas_principles", "variables"),
)

_FENCE = re.compile(r"^\s*(?:`{3,}|~{3,})[\w-]*\s*(.*?)\s*(?:`{3,}|~{3,})\s*$", re.S)
_FIRST = re.compile(r"[{\[]")


def read_json(text: str):
    """The complete JSON value of a text, out of code fences, prose or quoting around it; None where there is none."""
    for _ in range(4):
        text = text.strip().lstrip("﻿")
        fenced = _FENCE.match(text)
        if fenced:
            text = fenced.group(1)
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            start = _FIRST.search(text)
            if not start or text[:1] == '"':
                return None
            try:
                value, _ = json.JSONDecoder().raw_decode(text, start.start())
            except (ValueError, RecursionError):
                return None
        if not isinstance(value, str):
            return value
        text = value
    return None


def _opened(value):
    """A list or object given as JSON text is that list or object."""
    if isinstance(value, str) and value[:1].isspace() | (value[:1] in "[{"):
        bare = value.strip()
        if bare[:1] in ("[", "{"):
            try:
                found = json.loads(bare)
            except (ValueError, RecursionError):
                return value
            return found if isinstance(found, (list, dict)) else value
    return value


def _read(value, lists: frozenset):
    """``value`` with lists and objects given as JSON text opened, and lone values of the ``lists`` put into one."""
    value = _opened(value)
    if isinstance(value, list):
        return [_read(v, lists) for v in value]
    if isinstance(value, dict):
        out = {}
        for key, v in value.items():
            v = _read(v, lists)
            out[key] = [v] if key in lists and v is not None and not isinstance(v, list) else v
        return out
    return value


class _Node:
    """A place in the records: what stands there in any record of a batch, and the column of its scalars."""

    __slots__ = ("column", "depth", "items", "keys", "level", "name", "path", "up", "whole")

    def __init__(self, name: str | None, path: str, up: _Node | None, depth: int, level: int):
        self.name, self.path, self.up, self.depth, self.level = name, path, up, depth, level
        self.keys: dict[str, _Node] = {}
        self.items: _Node | None = None
        self.column: tuple[list, list, list, list] | None = None
        self.whole = False  # whether the column keeps whole elements beside scalars

    def key(self, name: str) -> _Node:
        if name not in self.keys:
            shown = f"`{name}`" if "." in name or "[" in name else name
            self.keys[name] = _Node(name, f"{self.path}.{shown}" if self.path else shown, self, self.depth, self.level + 1)
        return self.keys[name]

    def each(self) -> _Node:
        if self.items is None:
            self.items = _Node(None, self.path + "[]", self, self.depth + 1, self.level + 3)
        return self.items

    def all(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.keys.values())
            if node.items is not None:
                stack.append(node.items)


def _grow(node: _Node, value, scalar: set) -> None:
    """Add the places of a record; ``scalar`` collects those that hold scalars. An empty object counts as one."""
    if isinstance(value, dict) and value:
        for key, v in value.items():
            child = node.key(key)
            if v is not None:
                _grow(child, v, scalar)
    elif isinstance(value, list):
        each = node.each()
        for v in value:
            if v is not None:
                _grow(each, v, scalar)
    else:
        scalar.add(node)


def _absent(node: _Node, row: int, rep: int, level: int) -> None:
    """One entry without a value in every column at and below a place."""
    for n in node.all() if node.keys or node.items is not None else (node,):
        if n.column is not None:
            rows, reps, levels, values = n.column
            rows.append(row)
            reps.append(rep)
            levels.append(level)
            values.append(None)


def _shred(node: _Node, value, row: int, rep: int) -> None:
    """The entries of a value that is there, in every column at and below its place."""
    level, is_dict, is_list = node.level, isinstance(value, dict), isinstance(value, list)
    if node.column is not None:
        scalar = not is_list and not (is_dict and value)
        rows, reps, levels, values = node.column
        rows.append(row)
        reps.append(rep)
        levels.append(level + scalar)
        values.append(value if scalar or node.whole else None)
    if node.items is not None:
        if not is_list or not value:
            _absent(node.items, row, rep, level + is_list)
        else:
            each = node.items
            for i, v in enumerate(value):
                again = each.depth if i else rep
                if v is None:
                    _absent(each, row, again, level + 2)
                else:
                    _shred(each, v, row, again)
    for key, child in node.keys.items():
        v = value.get(key) if is_dict else None
        if v is None:
            _absent(child, row, rep, level)
        else:
            _shred(child, v, row, rep)


def _columns(texts: list[str | None], lists: frozenset, wanted: Callable[[_Node], bool] | None, whole: bool = False) -> list[_Node]:
    """The places with a column, over a batch of records; only the ``wanted`` ones, or all lists and scalars."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    root, scalar, records = _Node(None, "", None, 0, 0), set(), []
    for row, text in enumerate(texts):
        record = read_json(text) if text else None
        if record is not None:
            record = _read(record, lists)
            records.append((row, record))
            _grow(root, record, scalar)
    places = [n for n in root.all() if (wanted(n) if wanted else n in scalar or n.name is None)]
    for n in places:
        n.column, n.whole = ([], [], [], []), whole
    if wanted:
        _prune(root)
    for row, record in records:
        _shred(root, record, row, 0)
    return [n for n in places if n.column[0]]


def _prune(node: _Node) -> bool:
    """Drop the places below which there is no column, as a reader of columns skips those not asked for."""
    node.keys = {k: c for k, c in node.keys.items() if _prune(c)}
    if node.items is not None and not _prune(node.items):
        node.items = None
    return node.column is not None or bool(node.keys) or node.items is not None


def _position(rep: np.ndarray, depth: int) -> np.ndarray:
    """Place of every entry's element within its list of this depth: entries that begin one, counted since the list began."""
    begins = np.cumsum(rep <= depth)
    return begins - np.maximum.accumulate(np.where(rep < depth, begins, 0))


def _named(node: _Node, fields: tuple) -> tuple[str, bool] | None:
    """``(child, has a parent element)`` of the places that are the elements of a child table."""
    for f in fields:
        if isinstance(f, Single):
            up = node.up
            while up is not None and up.name is None:
                up = up.up
            if node.name == f.name and up is not None and up.name == f.holder:
                return f.name, False
        elif node.name is None and node.up is not None:
            held, inside = node.up, node.up.up
            if held.name == f.name:
                return f.name, False
            of_element = inside is not None and inside.name is None and inside.up is not None and inside.up.name == f.name
            if f.child and held.name == f.child and of_element:
                return f.child, True
            if f.bare_lists and held.name is None and inside is not None and inside.name == f.name:
                return f.child, True
    return None


def _lists(fields: tuple) -> frozenset:
    return frozenset(n for f in fields if isinstance(f, Repeated) for n in (f.name, f.child) if n)


def child_tables(records: DataFrame, row_id: str, text: str, fields: tuple = RECORD_FIELDS, with_values: bool = False) -> DataFrame:
    """``(row_id, child, parent_pos, pos[, value])``: one row per non-null element of the listed fields.

    child is the field's name, pos the element's place in its list, parent_pos -1 or
    the place of the element that holds the list, value the element as JSON. Only the
    level columns of these fields are filled, all places are counts over their levels. A null text, or one
    that holds no complete JSON value, gives no row; a null element keeps its place
    without a row; a field met twice in a record gives the elements of both. Records
    are read whole at any depth and length, repeated rows are shredded each, other
    columns are ignored.
    """
    lists = _lists(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for node in _columns(part.column(1).to_pylist(), lists, lambda n: _named(n, fields) is not None, with_values):
                    child, inner = _named(node, fields)
                    row, rep, level = (np.asarray(x) for x in node.column[:3])
                    there = np.flatnonzero(level >= node.level)
                    if not len(there):
                        continue
                    pos = _position(rep, node.depth) if node.name is None else np.zeros(len(rep), np.int64)
                    parent = _position(rep, node.depth - 1) if inner else np.full(len(rep), -1)
                    ids = part.column(0).take(pa.array(row[there]))
                    name = pa.array([child]).take(pa.array(np.zeros(len(there), np.int32)))
                    out = {row_id: ids, "child": name, "parent_pos": pa.array(parent[there]), "pos": pa.array(pos[there])}
                    if with_values:
                        out["value"] = pa.array([json.dumps(node.column[3][i], ensure_ascii=False) for i in there], pa.string())
                    yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = records.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, child string, parent_pos long, pos long" + (", value string" if with_values else "")
    return records.where(F.col(text).isNotNull()).select(row_id, text).mapInArrow(run, schema)


def level_columns(records: DataFrame, row_id: str, text: str, fields: tuple = RECORD_FIELDS) -> DataFrame:
    """``(row_id, path, entry, rep, def, top, value)``: the level columns of every leaf path and every list, entries of a record in order.

    ``top`` is the definition level at which the path's place is there and not null;
    ``value`` is the scalar as JSON. A path that no record of a batch has gives no
    entry. Lone values of the listed ``fields`` count as lists of one.
    """
    lists = _lists(fields)
    columns = [row_id, "path", "entry", "rep", "def", "top", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for node in _columns(part.column(1).to_pylist(), lists, None):
                    row, rep, level = (np.asarray(x, np.int64) for x in node.column[:3])
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    entry = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                    value = pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in node.column[3]], pa.string())
                    same = [pa.array([x]).take(pa.array(np.zeros(len(row), np.int32))) for x in (node.path, node.level)]
                    numbers = [pa.array(x.astype(np.int32)) for x in (rep, level)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), same[0], pa.array(entry), *numbers, same[1].cast(pa.int32()), value], columns)

    kind = records.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, path string, entry long, rep int, def int, top int, value string"
    return records.where(F.col(text).isNotNull()).select(row_id, text).mapInArrow(run, schema)


def ancestor_table(levels: DataFrame, row_id: str, ancestor: str) -> DataFrame:
    """``(row_id, ancestor, places, leaf, inner, value)``: the table of a repeated ancestor, from the levels alone.

    ``ancestor`` is a pattern for the beginning of paths, up to a list's ``[]``. places
    holds the element's place and before it those of all elements around it; leaf is
    the path below the element (empty for itself), inner the places within lists below
    it. There is a row for each leaf entry with a value and for each element of
    a list, of this one or one below it. ``levels`` must have one record per row_id; an empty one gives no rows.
    """
    held = levels.withColumn("ancestor", F.regexp_extract("path", ancestor, 0)).where(F.col("ancestor").endswith("[]"))
    held = held.withColumn("leaf", F.substring("path", F.length("ancestor") + 1, F.length("path")))
    held = held.where((F.col("leaf") == "") | F.col("leaf").startswith(".") | F.col("leaf").startswith("["))
    lists = lambda c: F.size(F.split(c, r"\[\]")) - 1
    deepest = held.agg(F.max(lists("path"))).first()[0] or 1  # lists within lists, a handful
    order = f"over (partition by `{row_id}`, path order by entry rows unbounded preceding)"
    begun = held.selectExpr("*", *[f"sum(int(rep <= {j})) {order} as s{j}" for j in range(1, deepest + 1)])
    counted = begun.selectExpr("*", *[f"s{j} - max(if(rep < {j}, s{j}, 0)) {order} as p{j}" for j in range(1, deepest + 1)])
    places, depth = F.array(*[F.col(f"p{j}") for j in range(1, deepest + 1)]), lists("ancestor")
    there = F.col("value").isNotNull() | (F.col("path").endswith("[]") & (F.col("def") >= F.col("top")))
    return counted.where(there).select(
        row_id, "ancestor", F.slice(places, F.lit(1), depth).alias("places"), "leaf", F.slice(places, depth + 1, lists("path") - depth).alias("inner"), "value"
    )
