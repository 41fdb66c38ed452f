"""Session helpers shared by every operator: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that ``broadcast_if_small`` ships to every executor.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset and all runs on this machine (tests) make a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path beside the checkpoints, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def broadcast_if_small(frame: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where ``rows`` (counted by the caller) prove that it fits; else leave the join to AQE."""
    return F.broadcast(frame) if rows * row_bytes <= BROADCAST_BYTES else frame


def is_empty(frame: DataFrame) -> bool:
    return not frame.take(1)


def sql_over(text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Run SQL that names DataFrames as ``@name``; ``args`` fill ``:name`` markers."""
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        view = f"{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        text = re.sub(rf"@{name}\b", view, text)
    return spark.sql(text, args=args or {})


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of a few MB each, so that long texts do not pile up as Python objects."""
    rows = max(1, int(len(batch) * limit / max(batch.nbytes, 1)))
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)
