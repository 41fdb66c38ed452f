"""Statistics over model outputs: descriptions, comparisons, significance, labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def describe(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(keys, metric, n, mean, median, stdev, low, high)`` of each metric; nulls are skipped, one value has stdev 0."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    long = long.select(*keys, "x.metric", "x.v").where("v is not null and not isnan(v)")
    return long.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"),
        F.min("v").alias("low"), F.max("v").alias("high"),
    )


def best_of_n(rows: DataFrame, keys: list[str], score: str, tie: str, kept: list[str]) -> DataFrame:
    """The row with the highest score of each group, the first by ``tie``; rows without a score take no part."""
    usable = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.min_by(F.struct(*kept), F.struct(-F.col(score), F.col(tie))).alias("best")
    return usable.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in kept])


def improvement(stats: DataFrame, key: str, method: str, value: str, baseline: str) -> DataFrame:
    """``(key, method, value, base, percent)``: change against the baseline method, null where that is not positive."""
    base = stats.where(F.col(method) == baseline).select(key, F.col(value).alias("base"))
    rows = stats.where(F.col(method) != baseline).join(base, key)
    return rows.select(key, method, value, "base", F.when(F.col("base") > 0, (F.col(value) - F.col("base")) / F.col("base") * 100).alias("percent"))


def win_rates(comparisons: DataFrame, keys: list[str], winner: str) -> DataFrame:
    """``(keys, wins, losses, ties, win_rate)``: A wins, B loses, all else is a tie."""
    w = F.upper(F.trim(winner))
    wins, losses = F.count_if(w == "A"), F.count_if(w == "B")
    return comparisons.groupBy(*keys).agg(
        wins.alias("wins"), losses.alias("losses"), (F.count("*") - wins - losses).alias("ties"), (wins / F.count("*")).alias("win_rate")
    )


def sign_z(wins: Column, losses: Column) -> Column:
    """Normal statistic of the sign test; 0 without a decided comparison."""
    n = wins + losses
    return F.when(n == 0, 0.0).otherwise((wins - n / 2) / F.sqrt(n / 4))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Probability of a normal statistic at least as far from 0."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def effect_size(wins: Column, losses: Column, ties: Column) -> Column:
    """Difference of win and loss shares, ties half each, over one half."""
    n = wins + losses + ties
    return F.when(n == 0, 0.0).otherwise((wins - losses) / n / 0.5)


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, confidence: float = 0.95, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """``(keys, mean, low, high)``: percentile interval of the mean.

    Each row draws its Poisson(1) count for every resample where it lies, from a hash of the row and the resample
    alone, so that results do not change with the partitioning. A resample is two partial sums per group and no
    group gathers in one task. Equal rows draw alike; rows without a value take no part.
    """
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    # chances of at most 0, 1, 2 ... draws
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(resamples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.iloc[low : low + 2000].reset_index(drop=True)
                with np.errstate(over="ignore"):
                    h = part["_h"].to_numpy().astype(np.uint64)[:, None] ^ salt[None]
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
                counts = np.searchsorted(steps, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
                v = part["_v"].to_numpy()
                for key, at in part.groupby(keys, dropna=False).indices.items():
                    c = counts[at]
                    out = pd.DataFrame({"r": np.arange(resamples), "s": (c * v[at, None]).sum(0), "n": c.sum(0)})
                    for k, x in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
                        out[k] = x
                    yield out[[*keys, "r", "s", "n"]]

    usable = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(*rows.columns).alias("_h")).where("_v is not null and not isnan(_v)")
    drawn = usable.mapInPandas(draw, ", ".join([*kinds, "r int", "s double", "n long"]))
    means = drawn.groupBy(*keys, "r").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    sorted_means = means.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("m"))
    tail = (1 - confidence) / 2
    at = lambda q: F.get("m", F.least(F.floor(F.lit(q) * F.size("m")).cast("int"), F.size("m") - 1))
    mean = usable.groupBy(*keys).agg(F.avg("_v").alias("mean"))
    return mean.join(sorted_means.select(*keys, at(tail).alias("low"), at(1 - tail).alias("high")), keys)


def label_metrics(rows: DataFrame, category: str, correct: Column, wrong: Column, rating: Column) -> DataFrame:
    """``(category, n, precision, hallucination_rate, rating)`` per category and in all (category null); unlabelled rows are skipped."""
    labelled = rows.where(correct.isNotNull())
    return labelled.rollup(category).agg(
        F.count("*").alias("n"), F.avg(correct.cast("double")).alias("precision"), F.avg(wrong.cast("double")).alias("hallucination_rate"), F.avg(rating).alias("rating")
    )


def histogram(rows: DataFrame, value: Column, name: str = "bucket") -> DataFrame:
    """``(bucket, n, percent)``."""
    counts = rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.withColumn("percent", F.col("n") * 100.0 / max(total, 1))
