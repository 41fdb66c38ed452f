"""Ranks, running sums and moving frames over ordered groups of any size.

A plain window puts a whole group into one task. Here a group is cut along its
order into buckets of a bounded number of rows, rows near an edge are also given to
the neighbouring bucket as context, and small tables of bucket totals carry what
came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.runtime import broadcast_if_small, cut_lineage

#: Rows of a group that one task orders at a time.
BUCKET = 1 << 17


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their 0-based rank within ``keys``; ``order`` must tell the rows of a group apart.

    Rows are range-partitioned by keys and order, so a large group lies in several
    partitions; ranks count within each, and the groups that span partitions, at
    most two per partition edge, get the counts before them added. Null keys are a
    group of their own.
    """
    by = [F.col(k) for k in keys]
    ranged = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    # written once: the ranges come from a sample, and counts and rows must refer to one drawing of them
    placed = cut_lineage(ranged)
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    spans = counts.groupBy(*keys).agg(F.count("*").alias("_parts")).where("_parts > 1")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    wide = counts.join(spans, same(counts, spans), "left_semi")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = wide.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    skips = skips.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_skip")
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(broadcast_if_small(skips, 4 * placed.rdd.getNumPartitions(), 256), on, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_skip", F.lit(0))).select(*rows.columns, name)


def moving(rows: DataFrame, keys: list[str], order: list[Column | str], before: int, after: int, bucket: int = BUCKET, **outputs: Column) -> DataFrame:
    """``rows`` with aggregates over the rows from ``before`` ahead of them to ``after`` behind them, themselves included.

    ``outputs`` are aggregate Columns by name. Exact for groups of any size; each
    bucket borrows only the rows its frames reach.
    """
    if max(before, after) >= bucket:
        raise ValueError("a frame must be smaller than a bucket")
    at = ranked(rows, keys, order, "_rank").withColumn("_bucket", F.floor(F.col("_rank") / bucket))
    inside = F.col("_rank") % bucket
    # a row also goes to the next bucket if frames there reach back to it, and to the one before if they reach ahead
    homes = F.array_compact(
        F.array(F.col("_bucket"), F.when(inside >= bucket - before, F.col("_bucket") + 1), F.when((inside < after) & (F.col("_bucket") > 0), F.col("_bucket") - 1))
    )
    spread = at.withColumn("_home", F.explode(homes))
    frame = Window.partitionBy(*keys, "_home").orderBy("_rank").rowsBetween(-before, after)
    done = spread.select("*", *[c.over(frame).alias(n) for n, c in outputs.items()])
    return done.where("_home = _bucket").select(*rows.columns, *outputs)


def running_sum(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and including them."""
    at = cut_lineage(ranked(rows, keys, order, "_rank").withColumn("_bucket", F.floor(F.col("_rank") / bucket)))
    totals = at.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.sum("_t").over(earlier).alias("_carried"))
    carried = carried.where("_carried is not null")
    here = Window.partitionBy(*keys, "_bucket").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    local = at.withColumn("_s", F.sum(value).over(here))
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    total = F.when(F.col("_s").isNull() & F.col("_carried").isNull(), None).otherwise(F.coalesce("_s", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return local.join(carried, on, "left").select(*rows.columns, total.alias(name))


def trailing(rows: DataFrame, keys: list[str], ts: str, seconds: int, **outputs: Column) -> DataFrame:
    """``rows`` with aggregates over the rows of their keys in the time before, both boundaries included.

    Groups are cut into stretches of that length; a row also goes to the stretch
    after its own, so a task holds two stretches of a group. A null time has no frame
    but its own.
    """
    micros = F.unix_micros(ts)
    at = rows.withColumn("_at", micros).withColumn("_slot", F.floor(micros / (seconds * 1_000_000)))
    spread = at.withColumn("_home", F.explode(F.when(F.col("_slot").isNull(), F.array(F.col("_slot"))).otherwise(F.array(F.col("_slot"), F.col("_slot") + 1))))
    frame = Window.partitionBy(*keys, "_home").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    done = spread.select("*", *[c.over(frame).alias(n) for n, c in outputs.items()])
    return done.where(F.col("_home").eqNullSafe(F.col("_slot"))).select(*rows.columns, *outputs)
