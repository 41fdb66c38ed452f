"""Telemetry as streams: windowed rates, rolling means, alerts that fire once, status changes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of the Parquet files of a table, be it one file or a folder of files."""
    folder, _, first = spark.read.schema(EVENTS).parquet(path).inputFiles()[0].rpartition("/")
    names = "*.parquet" if folder.endswith(path.rpartition("/")[2]) else first
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_calls(events: DataFrame, key: str = "event_type", late: str | None = "2 hours", size: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """``(window, key, calls, cost)`` per sliding window, late events up to the watermark included; without one (None) all, however late."""
    if late is not None:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size, slide), key).agg(F.count("*").alias("calls"), F.sum("value").alias("cost"))


def _order(events: DataFrame) -> DataFrame:
    """Events with their place in time: microseconds (a null time is oldest) and, among equal ones, the id."""
    oldest = F.lit(-(1 << 63)).cast("long")
    return events.withColumn("at", F.coalesce(F.unix_micros("ts"), oldest)).withColumn("id", F.coalesce("event_id", oldest))


def rolling_means(events: DataFrame, key: str = "event_type", keep: int = 100) -> DataFrame:
    """``(key, n, mean)`` over the newest values of each key by time and id, one row per key and batch.

    A group comes in frames of no promised order, and files may overlap in time, so
    the state holds the ``keep`` newest values with their places.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            there = frame.dropna(subset=["value"])
            last = heapq.nlargest(keep, last + list(zip(there["at"].tolist(), there["id"].tolist(), there["value"].tolist(), strict=True)))
        state.update(tuple([x[i] for x in last] for i in range(3)))
        yield pd.DataFrame({key: [group[0]], "n": [len(last)], "mean": [sum(x[2] for x in last) / len(last) if last else None]})

    return _order(events).select(key, "at", "id", "value").groupBy(key).applyInPandasWithState(
        update, f"{key} string, n long, mean double", "at array<long>, id array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout
    )


def budget_alerts(events: DataFrame, budget: float, key: str = "event_type", marks: tuple[float, ...] = (0.75, 0.9, 1.0)) -> DataFrame:
    """``(key, mark, spent)``: each mark of a key's budget once, when its spending first reaches it."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, fired = state.get if state.exists else (0.0, 0)
        for frame in frames:
            spent += float(frame["value"].fillna(0).sum())
        now = sum(spent >= m * budget for m in marks)
        state.update((spent, max(now, fired)))
        yield pd.DataFrame({key: [group[0]] * max(now - fired, 0), "mark": list(marks[fired:now]), "spent": [spent] * max(now - fired, 0)})

    return events.select(key, "value").groupBy(key).applyInPandasWithState(
        update, f"{key} string, mark double, spent double", "spent double, fired int", "update", GroupStateTimeout.NoTimeout
    )


def status_runs(events: DataFrame, key: str = "user_id", status: str = "event_type", days: int = 30) -> DataFrame:
    """``(key, span, at, id, status)``: where each run of one status begins within a span of days, all runs of a span anew in each batch that touches it.

    Rows may come in any order, within a batch and across batches: the state holds
    the rows of a key and span, so a late row is put in its place. A later batch
    replaces what an earlier one said of the same key and span; ``settled_changes``
    reads the runs back.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            rows.extend(zip(frame["at"].tolist(), frame["id"].tolist(), frame["status"].tolist(), strict=True))
        rows.sort(key=lambda r: r[:2])
        state.update(tuple([r[i] for r in rows] for i in range(3)))
        runs = [r for i, r in enumerate(rows) if i == 0 or r[2] != rows[i - 1][2]]
        yield pd.DataFrame([(*group, *r) for r in runs], columns=[key, "span", "at", "id", "status"])

    placed = _order(events).withColumn("span", F.floor(F.col("at") / (days * 86_400_000_000)).cast("long"))
    kind = events.schema[key].dataType.simpleString()
    return placed.select(key, "span", "at", "id", F.col(status).alias("status")).groupBy(key, "span").applyInPandasWithState(
        update, f"{key} {kind}, span long, at long, id long, status string", "at array<long>, id array<long>, status array<string>", "update", GroupStateTimeout.NoTimeout
    )


def settled_changes(runs: DataFrame, key: str = "user_id") -> DataFrame:
    """``(key, ts, old_status, new_status)``: a row whenever a key's status differs from the one before, from the runs of all batches (``batch``)."""
    newest = runs.groupBy(key, "span").agg(F.max("batch").alias("batch"))
    same = F.lit(True)
    for c in (key, "span", "batch"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}"))
    latest = runs.alias("r").join(newest.alias("n"), same, "left_semi")
    by_time = Window.partitionBy(key).orderBy("at", "id")
    told = latest.withColumn("old_status", F.lag("status").over(by_time)).withColumn("first", F.row_number().over(by_time) == 1)
    changed = told.where(F.col("first") | ~F.col("old_status").eqNullSafe(F.col("status")))
    at = F.when(F.col("at") > -(1 << 63), F.timestamp_micros("at"))
    return changed.select(key, at.alias("ts"), "old_status", F.col("status").alias("new_status"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all files that are there, into Parquet, resuming from its checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
