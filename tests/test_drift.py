import json

import pytest

from concordat.operators import drift

SCHEMA = "feed string, file_no int, file_name string, line_no int, payload string"


def lines(spark, files, feed="f"):
    rows = [(feed, no, f"{no}.json", i, json.dumps(rec) if not isinstance(rec, str) else rec) for no, recs in files.items() for i, rec in enumerate(recs)]
    return spark.createDataFrame(rows, SCHEMA)


def report(frame):
    return {tuple(r)[1:] for r in drift.drift_report(drift.ingest(frame)).collect()}


@pytest.fixture
def files():
    models = ["boreal_r1", "ondine_7b", "sable_base"]
    one = [{"model_name": models[i % 3], "tokens_used": 1000 + i, "note": None} for i in range(12)]
    two = [{"generator": models[i % 3], "tokens_used": str(1000 + i), "extra": i % 2 == 0} for i in range(12)]
    return {1: one, 4: two}


def test_each_kind_of_change(spark, files):
    assert report(lines(spark, files)) == {(4, "renamed", "model_name", "generator"), (4, "retyped", "tokens_used", "tokens_used"), (4, "added", "", "extra"), (4, "removed", "note", "")}


def test_rare_keys_doubles_and_unreadable_lines_do_not_count(spark, files):
    files[1] += ['{"model_name": "bor', "[1, 2]", "", '{"odd": 1}']
    frame = lines(spark, files)
    assert report(frame.unionByName(frame).selectExpr("*", "'x' as field", "1 as kind")) == report(lines(spark, {1: files[1][:12], 4: files[4]}))


def test_nothing_in_nothing_out(spark, files):
    empty = lines(spark, files).limit(0)
    assert drift.drift_report(drift.ingest(empty)).count() == 0
    assert report(lines(spark, {1: files[1]})) == set()
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, 1, None, 1, '{"a": 1}')], SCHEMA)
    assert drift.drift_report(drift.ingest(nulls)).count() == 0


def test_rescued_values_are_replayed(spark, files):
    ingested = drift.ingest(lines(spark, files))
    first = {(r["file_no"], r["line_no"]): r for r in ingested.collect()}
    assert first[(4, 0)]["model_name"] is None and json.loads(first[(4, 0)]["_rescued"]["generator"]) == "boreal_r1"
    names = drift.approved_names(drift.drift_report(ingested))
    assert [tuple(r) for r in names.collect()] == [("f", "generator", "model_name")]
    rows = {(r["file_no"], r["line_no"]): r for r in drift.promote(ingested, names).collect()}
    assert len(rows) == 24
    assert rows[(4, 1)]["model_name"] == "ondine_7b" and rows[(4, 1)]["tokens_used"] == 1001.0
    assert set(rows[(4, 1)]["_rescued"]) == {"extra"}
    assert rows[(1, 2)]["model_name"] == "sable_base"


def test_lines_with_a_null_in_their_key_stand_each_for_itself(spark):
    rows = [("f", 1, None, None, '{"a": 1}'), ("f", 1, None, None, '{"a": 2}'), ("f", 1, None, None, '{"a": 2}'), ("f", None, None, 0, '{"a": 3}'), (None, 1, None, 0, '{"a": 4}')]
    rows += [rows[3], rows[4], ("f", 1, None, 0, '{"a": 5}'), ("f", 1, None, 0, '{"a": 5}')]
    got = drift.ingest(spark.createDataFrame(rows, SCHEMA)).selectExpr("_rescued['a'] as a").collect()
    assert sorted(r["a"] for r in got) == ["1", "2", "2", "3", "3", "4", "4", "5"]


def test_of_a_line_sent_twice_the_readable_one_is_kept(spark):
    whole = '{"model_name": "boreal_r1", "n": 1}'
    rows = [("f", 1, None, 0, whole[:20]), ("f", 1, None, 0, whole), ("f", 1, None, 1, whole[:9])]
    got = drift.ingest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["line_no"], r["model_name"]) for r in got] == [(0, "boreal_r1")]


def test_a_null_feed_is_a_feed_of_its_own(spark, files):
    got = drift.drift_report(drift.ingest(lines(spark, files, None).unionByName(lines(spark, {1: files[4], 4: files[4]}, "g")))).collect()
    assert {tuple(r) for r in got} == {(None, *c) for c in report(lines(spark, files))}
