import json

from pyspark.sql import functions as F

from concordat.sources import files, sinks
from concordat.streaming import telemetry as st


def test_question_files_and_trees(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question_id": "x"}, {"no": 1}, {"question_id": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps({"question_id": "z"}))
    (tmp_path / "c.json").write_text("{broken")
    got = files.question_files(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r["body"])["question_id"] for r in got if r["body"]) == ["x", "y", "z"]
    deep = tmp_path / "t" / "2020" / "E_2020_Q1" / "m1"
    deep.mkdir(parents=True)
    (deep / "response.json").write_text("{}")
    assert tuple(files.response_tree(spark, str(tmp_path / "t")).first())[:3] == (2020, "E_2020_Q1", "m1")


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("q", 1, None, ["a"]), ("r", 2, True, None)], "question_id string, n int, ok boolean, l array<string>")
    assert json.loads(frame.select(sinks.tagged(frame).alias("j")).first()["j"]) == {"question_id": {"S": "q"}, "n": {"N": "1"}, "l": {"L": ["a"]}}
    sinks.write_versioned(frame.drop("ok", "l"), str(tmp_path / "v"), "1")
    sinks.write_versioned(frame.drop("ok", "l").withColumn("n", F.col("n") + 10), str(tmp_path / "v"), "2")
    assert sorted(r["n"] for r in files.newest_version(spark, str(tmp_path / "v")).collect()) == [11, 12]
    sinks.write_cache(frame, str(tmp_path / "c"), 3600)
    assert sinks.live_cache(spark.read.parquet(str(tmp_path / "c"))).count() == 2

    def fails(_):
        raise OSError("full")

    assert sinks.write_all(frame, {"a": fails, "b": lambda f: f.count()}) == {"a": "full"}


def test_logs(spark, tmp_path):
    (tmp_path / "l.log").write_text("ok\nConnection ERROR\n")
    assert files.log_lines(spark, str(tmp_path), "error").count() == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    stream = st.windowed_calls(st.event_stream(spark, f"{sf_dir}/events.parquet"), late="0 seconds", size="1 day", slide="1 day")
    st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {(r["window"]["start"], r["event_type"]): r["calls"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count().collect()
    want = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch}
    assert got and all(want[k] == n for k, n in got.items())
