"""Voting over the values that several models give for a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.ordering import ranked

#: Weight of a model that a strategy does not name.
DEFAULT_WEIGHT = 0.25


def weighted_average(values: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``(keys, average)`` over the values that are there; null where their weights sum to 0."""
    there = F.col(value).isNotNull() & F.col(weight).isNotNull()
    total = F.sum(F.when(there, F.col(weight)))
    return values.groupBy(*keys).agg((F.sum(F.when(there, F.col(value) * F.col(weight))) / F.nullif(total, F.lit(0.0))).alias("average"))


def majority(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, votes)``: the most frequent value, the smallest on a tie; nulls do not vote."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col(value))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, f"best.{value}", "best.votes")


def weighted_vote(values: DataFrame, keys: list[str], value: str, weight: str, threshold: float = 0.7) -> DataFrame:
    """``(keys, winner, weight, share, status)``: accepted where the winner's share of all weight reaches the threshold.

    Values are compared as text, the smallest wins a tie; a group without a value is
    disputed with no winner.
    """
    sums = values.groupBy(*keys, F.col(value).cast("string").alias("v")).agg(F.sum(weight).alias("w"))
    best = F.min_by(F.struct("v", "w"), F.when(F.col("v").isNotNull(), F.struct(-F.round("w", 10), F.col("v")))).alias("best")
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("total")
    out = sums.groupBy(*keys).agg(best, total).withColumn("share", F.col("best.w") / F.nullif("total", F.lit(0.0)))
    status = F.when(F.round("share", 10) >= threshold, "accepted").otherwise("disputed")
    return out.select(*keys, F.col("best.v").alias("winner"), F.col("best.w").alias("weight"), "share", status.alias("status"))


def normalised_weights(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weights of each group scaled to sum to 1; groups with a null key are left out."""
    totals = weights.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    return weights.join(totals, keys).withColumn(weight, F.col(weight) / F.nullif("_total", F.lit(0.0))).select(weights.columns)


def strategy_weights(models: DataFrame, weights: DataFrame, keys: list[str], strategy: str, model: str) -> DataFrame:
    """Rows of ``models`` with the weight their strategy gives the model, a default where it names none, scaled per group."""
    named = models.join(weights.select(F.col("strategy").alias(strategy), F.col("model_name").alias(model), "weight"), [strategy, model], "left")
    return normalised_weights(named.withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT))), keys, "weight")


def with_tiebreaker(weights: DataFrame, keys: list[str], model: str, weight: str, name: str, share: float = 0.3) -> DataFrame:
    """Each group's weights scaled to the rest, and one more model with ``share``."""
    scaled = normalised_weights(weights.select(*keys, model, weight), keys, weight).withColumn(weight, F.col(weight) * (1 - share))
    extra = weights.select(*keys).distinct().select(*keys, F.lit(name).alias(model), F.lit(share).alias(weight))
    return scaled.unionByName(extra)


def red_line(values: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``(keys, red_line)``: whether any row denies the flag; a null denies nothing."""
    return values.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(flag) == F.lit(False)), F.lit(False)).alias("red_line"))


def _numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with ``_at``, their place in their group, and ``_n``, its size."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return ranked(rows, keys, [order], "_at").join(sizes, keys)


def batches(rows: DataFrame, keys: list[str], order: str, number: int = 8) -> DataFrame:
    """Rows with their ``batch``: contiguous slices of ``size div number`` rows, at least 1, per group."""
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / number))
    return _numbered(rows, keys, order).withColumn("batch", F.floor(F.col("_at") / size).cast("int")).select(*rows.columns, "batch")


def dispute_batches(rows: DataFrame, keys: list[str], order: str, most: int = 20) -> DataFrame:
    """Rows with ``batch`` and ``status``: one batch up to 3 rows, two up to 8, three up to 15, else slices of 5.

    Rows beyond ``most`` are kept with status ``unprocessed`` and no batch.
    """
    at, n = F.col("_at"), F.col("_n")
    halves = F.when(at < F.floor(n / 2), 0).otherwise(1)
    batch = F.when(n <= 3, 0).when(n <= 8, halves).when(n <= 15, F.floor(at / F.floor((n + 2) / 3))).otherwise(F.floor(at / 5))
    queued = F.when(at < most, "queued").otherwise("unprocessed")
    out = _numbered(rows, keys, order).withColumn("status", queued).withColumn("batch", F.when(at < most, batch.cast("int")))
    return out.select(*rows.columns, "status", "batch")


def first_known(*candidates: Column) -> Column:
    """Resolution by priority: the first source that has a value."""
    return F.coalesce(*candidates)


def quality_score(confidence: Column, consensus: Column, rounds: Column, relevance: Column, filled: Column) -> Column:
    """Weighted mean of five measures; a missing one takes its default, 150 filled fields count as complete."""
    efficiency = F.when(rounds == 0, 1.0).when(rounds == 1, 0.9).otherwise(0.7)
    return (
        0.25 * F.coalesce(confidence, F.lit(0.75)) + 0.30 * F.coalesce(consensus, F.lit(0.9)) + 0.20 * efficiency
        + 0.15 * F.coalesce(relevance, F.lit(0.7)) + 0.10 * F.least(filled / 150.0, F.lit(1.0))
    )


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.9, "GOLD").when(score >= 0.8, "SILVER").when(score >= 0.7, "BRONZE").otherwise("REVIEW")


def merged_value(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``(keys, value)``: the most frequent value as text, the earliest by ``order`` on a tie; empty texts and objects do not count."""
    counts = values.where(~F.coalesce(F.trim(value).isin("", "null", "{}", "[]", '""'), F.lit(True))).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("o"))).alias(value))


def missing_paths(expected: DataFrame, given: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Expected paths that an answer lacks."""
    return expected.select(*keys, path).distinct().join(given.select(*keys, path), [*keys, path], "left_anti")


def answered_by_enough(rows: DataFrame, key: str, model: str, least: int = 2) -> DataFrame:
    """Keys that at least so many different models answered."""
    return rows.groupBy(key).agg(F.count_distinct(model).alias("models")).where(F.col("models") >= least)


def swapped_back(winner: Column, swapped: Column) -> Column:
    """A winner as it was before the two sides changed places; anything but A and B is a tie."""
    w = F.upper(F.trim(winner))
    plain = F.when(w.isin("A", "B"), w).otherwise("TIE")
    return F.when(swapped & (plain == "A"), "B").when(swapped & (plain == "B"), "A").otherwise(plain)


def section_of(path: Column) -> Column:
    """Section of a leaf path, ``other`` outside the numbered ones."""
    section = F.regexp_extract(path, r"^(tier_\d)", 1)
    return F.when(section == "", "other").otherwise(section)


def budget_status(spent: Column, limit: Column | float) -> Column:
    share = spent / limit
    return F.when(share >= 1.0, "EXCEEDED").when(share >= 0.9, "CRITICAL").when(share >= 0.75, "WARNING").otherwise("OK")
