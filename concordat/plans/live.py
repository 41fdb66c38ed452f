"""Streaming queries, run over all files that are there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.plans.base import Registry
from concordat.runtime import shared_folder
from concordat.streaming import telemetry as st

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Output and progress go to the folder that all executors share."""
    base = shared_folder(spark, "stream")
    if mode == "append":
        st.run_available(stream, f"{base}/out", f"{base}/progress")
        return spark.read.parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.event_stream(spark, f"{sf_dir}/events.parquet")


@_R.query("""select event_type, start, count(*) as calls, round(sum(value), 6) as cost from
(select event_type, value, time_bucket(interval 5 minutes, ts::timestamp) - i * interval 5 minutes as start from events, range(12) r(i) where ts is not null) group by 1, 2""")
def str_01_windowed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of the whole table, the open ones of the last hours too; the newest batch that touches a window holds its sums."""
    out = _run(spark, st.windowed_calls(_events(spark, sf_dir), late=None), "update")
    last = out.groupBy("event_type", F.col("window.start").alias("start")).agg(F.max_by(F.struct("calls", "cost"), "batch").alias("s"))
    return last.select("event_type", "start", "s.calls", F.round("s.cost", 6).alias("cost"))


@_R.query("""select event_type, count(*) as n, round(avg(value), 6) as mean from (select *, row_number() over (partition by event_type order by ts desc) as r from events where value is not null) where r <= 100 group by 1""")
def str_02_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, st.rolling_means(_events(spark, sf_dir)), "update")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "mean"), "batch").alias("s"))
    return last.select("event_type", "s.n", F.round("s.mean", 6).alias("mean"))


@_R.query("""select event_type, mark::double as mark from (select event_type, sum(value) as s from events group by 1), (values (0.75), (0.9), (1.0)) t(mark) where s >= mark * 5000""")
def str_03_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, st.budget_alerts(_events(spark, sf_dir), 5000.0), "update").select("event_type", "mark")


@_R.query("""select user_id, count(*) as changes from (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p <> event_type group by 1""")
def str_04_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _run(spark, st.status_runs(_events(spark, sf_dir)), "update")
    return st.settled_changes(runs).groupBy("user_id").agg(F.count("*").alias("changes"))
