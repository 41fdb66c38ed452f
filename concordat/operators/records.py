"""Reshaping of questions and nested records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.shredding import read_json
from concordat.runtime import slices


def leaf_paths(value, prefix: str = "") -> Iterator[tuple[str, str, str]]:
    """Path, type and JSON text of every leaf; an empty object or list is a leaf. Names with a dot stand in backticks."""
    stack = [(prefix, value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict) and node:
            for k in reversed(list(node)):
                name = f"`{k}`" if "." in k or "[" in k else k
                stack.append((f"{path}.{name}" if path else name, node[k]))
        elif isinstance(node, list) and node:
            stack.extend((f"{path}[{i}]", node[i]) for i in range(len(node) - 1, -1, -1))
        else:
            kind = {dict: "object", list: "list", str: "text", bool: "boolean", int: "number", float: "number"}.get(type(node), "null")
            yield path, kind, json.dumps(node, ensure_ascii=False)


def flattened(records: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, path, type, value)``: every leaf of every readable JSON record, also of one in a fence, prose or quoting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, body in enumerate(part.column(1).to_pylist()):
                    record = read_json(body)
                    if record is not None or body.strip() == "null":
                        rows.extend((i, *leaf) for leaf in leaf_paths(record))
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    texts = [pa.array(c, pa.string()) for c in columns]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *texts], [row_id, "path", "type", "value"])

    kind = records.schema[row_id].dataType.simpleString()
    return records.where(F.col(text).isNotNull()).select(row_id, text).mapInArrow(run, f"`{row_id}` {kind}, path string, type string, value string")


def field_counts(leaves: DataFrame, row_id: str, records: DataFrame | None = None) -> DataFrame:
    """``(row_id, fields, filled)``: leaves in all and those that are neither null nor empty; 0 for the ``records`` without a leaf."""
    filled = F.count_if(F.col("path").isNotNull() & ~F.col("value").isin("null", '""', "[]", "{}"))
    if records is not None:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("path", "type", "value")]
        leaves = leaves.unionByName(records.select(row_id, *nothing))
    return leaves.groupBy(row_id).agg(F.count("path").alias("fields"), filled.alias("filled"))


def aligned(leaves: DataFrame, group: str, model: str, weight: str) -> DataFrame:
    """``(group, path, values)``: for each path what every model says, with its weight."""
    entry = F.struct(F.col(model).alias("model"), F.col("value"), F.col(weight).alias("weight"))
    return leaves.groupBy(group, "path").agg(F.sort_array(F.collect_list(entry)).alias("values"))


def set_path(value, path: list, new):
    """``value`` with ``new`` at the path of names and indexes; lists grow to fit."""
    if not path:
        return new
    head, rest = path[0], path[1:]
    if isinstance(head, int):
        items = list(value) if isinstance(value, list) else []
        items += [None] * (head + 1 - len(items))
        items[head] = set_path(items[head], rest, new)
        return items
    node = dict(value) if isinstance(value, dict) else {}
    node[head] = set_path(node.get(head), rest, new)
    return node


def with_path(records: DataFrame, text: str, path: list, new_json: str) -> DataFrame:
    """Records whose JSON column takes the value of another JSON column at a path; unreadable records stay as they are."""

    @F.pandas_udf("string")
    def put(body: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(body, new, strict=True):
            try:
                out.append(json.dumps(set_path(json.loads(b), path, json.loads(n)), ensure_ascii=False))
            except (TypeError, ValueError, RecursionError):
                out.append(b)
        return pd.Series(out)

    return records.withColumn(text, put(text, new_json))


def standard_question(raw: DataFrame) -> DataFrame:
    """Questions under canonical names: the first non-empty of each field's aliases, casts that never fail."""
    have = set(raw.columns)

    def first(*names: str) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    marks = first("marks").try_cast("double")
    return raw.select(
        first("question_id", "id").alias("question_id"), first("exam_name").alias("exam_name"), first("subject").alias("subject"),
        first("year").try_cast("int").alias("year"), first("question_number", "q_num").alias("question_number"),
        first("question_text", "question").alias("question_text"), first("question_type").alias("question_type"),
        F.when(F.coalesce(marks, F.lit(0.0)) == 0, 1.0).otherwise(marks).alias("marks"), first("answer_key", "correct_answer").alias("answer_key"),
    )


def options_map(kind: Column, letters: dict[str, Column] | None = None, listed: Column | None = None, mapped: Column | None = None) -> Column:
    """Options by letter from a map, four columns or a list of up to four; a numerical question has none."""
    sources = []
    if mapped is not None:
        sources.append(mapped)
    if listed is not None:
        four = F.slice(listed, 1, 4)
        sources.append(F.when(F.size(four) > 0, F.map_from_arrays(F.slice(F.array(*[F.lit(c) for c in "ABCD"]), 1, F.size(four)), four)))
    if letters:
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in letters.items()]), lambda p: p["v"].isNotNull())
        sources.append(F.when(F.size(pairs) > 0, F.map_from_entries(pairs)))
    return F.when(kind != "NAT", F.coalesce(*sources)) if sources else F.lit(None).cast("map<string,string>")


def embedding_text(text: Column, options: Column) -> Column:
    """Question text followed by its options as ``K: V``, in order of the letters."""
    parts = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" ", text, F.array_join(parts, " "))


def combined_type(content: Column, media: Column) -> Column:
    return F.concat_ws("_", content, media)


def weight_strategy(content: Column, media: Column) -> Column:
    """Strategy by content and media: images first, then derivations and numbers, then theory and application."""
    image, maths = media.contains("image"), content.contains("math")
    return (
        F.when(image & maths, "MATH_IMAGE_HYBRID").when(image, "VISION_WEIGHTED").when(maths, "MATH_WEIGHTED")
        .when(content.contains("numerical"), "NUMERICAL_WEIGHTED").when(content.contains("application"), "APPLICATION_WEIGHTED")
        .when(content.contains("conceptual"), "CONCEPTUAL_WEIGHTED").otherwise("BALANCED")
    )
