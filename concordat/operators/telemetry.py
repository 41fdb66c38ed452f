"""Cost and health accounting over a fact table of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators import ordering as od


def cost_sets(calls: DataFrame, model: str, stage: str, question: str, cost: str) -> DataFrame:
    """Cost and number of calls by model, stage, question, both pairs and in all, told apart by ``level``."""
    sets = calls.groupingSets(
        [[F.col(model)], [F.col(stage)], [F.col(question)], [F.col(question), F.col(model)], [F.col(question), F.col(stage)], []],
        F.col(model), F.col(stage), F.col(question),
    )
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.sum(cost).alias("cost"), F.count("*").alias("calls"))


def shares(calls: DataFrame, key: str, cost: str) -> DataFrame:
    """``(key, cost, share)``: each key's cost and its share of all."""
    sums = calls.groupBy(key).agg(F.sum(cost).alias("cost"))
    total = calls.agg(F.sum(cost).alias("t")).first()["t"]
    return sums.withColumn("share", F.col("cost") / F.nullif(F.lit(total or 0.0), F.lit(0.0)))


def most_expensive(calls: DataFrame, key: str, cost: str, n: int = 10) -> DataFrame:
    """The top-n report of cost, by key on a tie."""
    return calls.groupBy(key).agg(F.sum(cost).alias("cost"), F.count("*").alias("calls")).orderBy(F.desc(F.round("cost", 6)), key).limit(n)


def rolling_mean(calls: DataFrame, key: str, order: list[str], value: str, rows: int = 100) -> DataFrame:
    """Rows with the mean of the last ``rows`` values of their key."""
    return od.moving(calls, [key], order, rows - 1, 0, rolling_mean=F.avg(value))


def trailing_calls(calls: DataFrame, key: str, ts: str, seconds: int = 3600) -> DataFrame:
    """Rows with the number of calls of their key in the time before, the boundary included."""
    return od.trailing(calls, [key], ts, seconds, trailing_calls=F.count("*"))


def running_cost(calls: DataFrame, key: str, order: list[str], cost: str) -> DataFrame:
    return od.running_sum(calls, [key], order, cost, "running_cost")


def budget_crossings(calls: DataFrame, key: str, order: list[str], cost: str, budget: float, ts: str, marks: tuple[float, ...] = (0.75, 0.9, 1.0)) -> DataFrame:
    """``(key, mark, crossed_at)``: when each key's running cost first reached a share of its budget."""
    rows = running_cost(calls, key, order, cost).select(key, F.col(ts).alias("crossed_at"), "running_cost", F.explode(F.array(*[F.lit(m) for m in marks])).alias("mark"))
    return rows.where(F.round("running_cost", 6) >= F.col("mark") * budget).groupBy(key, "mark").agg(F.min("crossed_at").alias("crossed_at"))


def error_rate(calls: DataFrame, key: str, failed) -> DataFrame:
    """``(key, calls, errors, rate)``."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), (F.count_if(failed) / F.count("*")).alias("rate"))


def bottleneck(calls: DataFrame, key: str, stage: str, seconds: str) -> DataFrame:
    """``(key, stage, seconds)``: the stage that took longest in sum, the first by name on a tie."""
    sums = calls.groupBy(key, stage).agg(F.sum(seconds).alias("seconds"))
    best = F.min_by(F.struct(stage, "seconds"), F.struct(-F.round("seconds", 6), F.col(stage))).alias("best")
    return sums.groupBy(key).agg(best).select(key, f"best.{stage}", "best.seconds")


def history(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows with the values that came before them in their group, in order.

    A row holds all that came before it, so this is for short groups, such as the
    few questions that share one statement.
    """
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.collect_list(value).over(w))


def look_ahead(rows: DataFrame, group: str, order: list[str], value: str, n: int = 3) -> DataFrame:
    """Rows with the next ``n`` values of their group, in order; nulls are left out."""
    ahead = od.moving(rows, [group], order, 0, n, _list=F.collect_list(F.struct(F.lit(1).alias("one"), F.col(value).alias("v"))))
    rest = F.transform(F.slice("_list", 2, n), lambda s: s["v"])
    return ahead.withColumn("ahead", F.filter(rest, lambda v: v.isNotNull())).drop("_list")


def newest(rows: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """Rows with ``kept``: whether they are among the newest of their group."""
    return od.ranked(rows, [group], order, "_rank").withColumn("kept", F.col("_rank") < keep).drop("_rank")
