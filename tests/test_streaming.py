import random

import duckdb
from pyspark.sql import functions as F

from concordat.plans import live

START = 1_700_000_000_000_000


def write_events(spark, folder, rows, parts):
    """Events of shuffled files that overlap in time, each file in no order."""
    rows = list(rows)
    random.Random(5).shuffle(rows)
    for i in range(parts):
        frame = spark.createDataFrame(rows[i::parts], "event_id long, us long, user_id long, event_type string, value double").coalesce(1)
        frame = frame.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
        frame.write.mode("append").parquet(f"{folder}/events.parquet")


def test_rolling_mean_of_a_large_key_in_shuffled_order(spark, tmp_path):
    rows = [(i, START + 1_000_000 * i, i % 7, "a", float(i)) for i in range(25_000)]
    for parts in (1, 3):
        write_events(spark, tmp_path / str(parts), rows, parts)
        got = [tuple(r) for r in live.str_02_rolling_mean(spark, str(tmp_path / str(parts))).collect()]
        assert got == [("a", 100, sum(range(24_900, 25_000)) / 100)]


def test_status_changes_of_a_large_key_in_shuffled_order(spark, tmp_path):
    # runs of 50 events of one status, over more than one span of days
    rows = [(i, START + 300_000_000 * i, 1, "ab"[i // 50 % 2], 1.0) for i in range(25_000)]
    for parts in (1, 3):
        write_events(spark, tmp_path / str(parts), rows, parts)
        assert [tuple(r) for r in live.str_04_status_changes(spark, str(tmp_path / str(parts))).collect()] == [(1, 500)]


def test_windows_of_overlapping_files_hold_every_row(spark, tmp_path):
    rows = [(i, START + 60_000_000 * i, 1, "a", 1.0) for i in range(3_000)]
    for parts in (1, 3):
        write_events(spark, tmp_path / str(parts), rows, parts)
        got = live.str_01_windowed_calls(spark, str(tmp_path / str(parts))).collect()
        assert sum(r["calls"] for r in got) == 12 * 3_000 == sum(r["cost"] for r in got)
        assert len({r["start"] for r in got}) == len(got) and max(r["calls"] for r in got) == 60


def test_windows_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    want = {(t, s): (n, c) for t, s, n, c in con.sql("select event_type, start, calls, cost from (" + live.SQL["str_01_windowed_calls"] + ")").fetchall()}
    got = {(r["event_type"], r["start"]): (r["calls"], r["cost"]) for r in live.str_01_windowed_calls(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - c) < 1e-5 for k, (n, c) in want.items())
