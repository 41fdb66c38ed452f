import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from concordat.operators import ordering as od


def frame(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, 1.0, 2.5, 4.0])) for i in range(600)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i long, v double")


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_cut_groups_give_what_plain_windows_give(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the hot group in several partitions
    try:
        rows = frame(spark)
        w = Window.partitionBy("k").orderBy("i")
        assert as_set(od.ranked(rows, ["k"], ["i"]), "i", "rank") == as_set(rows.withColumn("rank", F.row_number().over(w) - 1), "i", "rank")
        moved = od.moving(rows, ["k"], ["i"], 3, 2, bucket=7, m=F.sum("v"), n=F.count("*"))
        assert as_set(moved, "i", "m", "n") == as_set(rows.select("i", F.sum("v").over(w.rowsBetween(-3, 2)).alias("m"), F.count("*").over(w.rowsBetween(-3, 2)).alias("n")), "i", "m", "n")
        sums = od.running_sum(rows, ["k"], ["i"], "v", "s", bucket=7)
        assert as_set(sums, "i", "s") == as_set(rows.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), "i", "s")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_trailing_times(spark):
    rows = frame(spark).withColumn("t", F.when(F.col("i") % 50 != 0, F.timestamp_seconds(F.col("i") * 7 % 900)))
    w = Window.partitionBy("k").orderBy(F.unix_micros("t")).rangeBetween(-60_000_000, 0)
    timed = rows.where("t is not null")
    got = od.trailing(rows, ["k"], "t", 60, n=F.count("*"), s=F.sum("v")).where("t is not null")
    assert as_set(got, "i", "n", "s") == as_set(timed.select("i", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s")), "i", "n", "s")


def test_empty(spark):
    assert od.ranked(frame(spark).limit(0), ["k"], ["i"]).count() == 0
