"""Records that are equal but for formatting, collapsed by a range-partitioned sort and a scan of adjacent runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.runtime import broadcast_if_small, cut_lineage

#: Signs that stay content stand as these letters while punctuation is dropped.
MINUS, PLUS, POINT, GAP = "\u0001", "\u0002", "\u0003", "\u0004"


def canonical_text(text: Column) -> Column:
    """Lower-case letters, digits and symbols of a text, with the sign and decimal point of its numbers.

    Whitespace, punctuation, control and format characters go; two numbers that
    only such characters part stay two numbers.
    """
    low = F.lower(text)
    numbers = low
    for pattern, by in (
        (r"(?<![\p{L}\p{N}])[-‐-―−](?=\.?\p{Nd})", MINUS),
        (r"(?<![\p{L}\p{N}])\+(?=\.?\p{Nd})", PLUS),
        (r"(?<=\p{Nd})\.(?=\p{Nd})|(?<![\p{L}\p{N}.])\.(?=\p{Nd})", POINT),
        (r"(?<=\p{Nd})[\p{P}\p{Z}\s\p{Cf}]+(?=\p{Nd})", GAP),
    ):
        numbers = F.regexp_replace(numbers, pattern, by)
    # most strings hold no number, and all but a few characters of the rest are plain
    signed = F.when(low.rlike(r"\p{Nd}"), numbers).otherwise(low)
    return F.regexp_replace(signed, r"[\p{P}\p{Z}\s\p{Cf}\u0000\u0005-\u001f\u007f-\u009f]+", "")


def canonical_json(column: str) -> Column:
    """Canonical form of a JSON text: keys in one order, every name and string as ``canonical_text``.

    Lists keep their order, numbers, booleans and nulls their value. A text that
    is not one JSON value is canonicalised as plain text; null stays null.
    """
    compact = F.to_json(F.try_parse_json(column))  # a variant holds the keys of an object in sorted order
    plain = F.regexp_replace(compact, r'\\(["\\/bfnrt]|u[0-9a-f]{4})', " ")
    # quotes are now structure only: every second piece is the inside of a string
    pieces = F.transform(F.split(plain, '"'), lambda piece, i: F.when(i % 2 == 1, canonical_text(piece)).otherwise(piece))
    return F.when(compact.isNotNull(), F.array_join(pieces, '"')).otherwise(F.concat(F.lit("!"), canonical_text(F.col(column))))


def canonical_record(columns: Sequence[str]) -> Column:
    """One key over several JSON columns; null and text never agree."""
    return F.concat_ws("\u0006", *[F.coalesce(F.concat(F.lit("="), canonical_json(c)), F.lit("~")) for c in columns])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted partition: ``(part, id, run_first)``, and two rows with the edge runs' keys.

    Only the last key and the first id of its run are carried from batch to batch,
    so a run may be of any length.
    """
    part = TaskContext.get().partitionId()
    last_key, first, began = None, None, None

    def rows(ids: pa.Array, firsts: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), part, np.int32)), ids, pa.array(firsts, pa.int64()), keys], ["part", "id", "run_first", "edge"]
        )

    for batch in batches:
        keys, ids = batch.column(0), batch.column(1)
        if not len(keys):
            continue
        before = pa.concat_arrays([pa.array([last_key], keys.type), keys.slice(0, len(keys) - 1)])
        fresh = pc.fill_null(pc.not_equal(keys, before), True).to_numpy(zero_copy_only=False)
        values = ids.to_numpy(zero_copy_only=False)
        firsts = np.concatenate([[-1 if first is None else first], values[fresh]])[np.cumsum(fresh)]
        if began is None:
            began = (keys[0].as_py(), int(firsts[0]))
        last_key, first = keys[-1].as_py(), int(firsts[-1])
        yield rows(ids, firsts, pa.nulls(len(ids), pa.string()))
    if began is not None:
        yield rows(pa.nulls(2, pa.int64()), np.array([began[1], first]), pa.array([began[0], last_key], pa.string()))


def copy_groups(records: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """``(first_id, id)`` of every record: the smallest id of the group of records equal to it.

    Records are equal if all ``columns`` (JSON texts or null) are equal by
    ``canonical_record``; records whose columns are all null are copies of each
    other. Other columns are ignored, an empty table gives no rows, texts of any
    length are compared whole, and a repeated id is a copy of itself.

    Records are range-partitioned and sorted by key and id, so a huge group spreads
    over as many partitions as its size asks for, and each partition is scanned
    once. A group that goes on over a partition's edge is one run in each; the first
    and last run of every partition, two rows each, are then joined by their keys.
    """
    keyed = records.select(canonical_record(columns).alias("key"), F.col(row_id).cast("long").alias("id"))
    # drawing the ranges and moving the records both read the keys; a lost part is made again from the records
    keyed = keyed.persist(StorageLevel.DISK_ONLY)
    ranged = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    # written once: the ranges come from a sample, and drawing them anew would move the edges
    runs = cut_lineage(ranged.mapInArrow(_scan_runs, "part int, id long, run_first long, edge string"))
    keyed.unpersist()
    edges = runs.where("id is null").select("part", "run_first", "edge").distinct()
    firsts = edges.groupBy("edge").agg(F.min("run_first").alias("group_first"))
    moved = edges.join(firsts, "edge").where("group_first <> run_first").select("part", "run_first", "group_first")
    rows = runs.where("id is not null").select("part", "run_first", "id")
    joined = rows.join(broadcast_if_small(moved, 2 * runs.rdd.getNumPartitions(), 64), ["part", "run_first"], "left")
    return joined.select(F.coalesce("group_first", "run_first").alias("first_id"), "id")


def collapsed(records: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """``(first_id, n_copies)``: one representative, the smallest id, and the exact size of each group."""
    return copy_groups(records, columns, row_id).groupBy("first_id").agg(F.count("*").alias("n_copies"))
