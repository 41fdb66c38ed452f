import json
import random

from pyspark.sql import functions as F

from concordat.llm import copies as cp

COLUMNS = ("common_mistakes", "mnemonics_memory_aids", "flashcards")
SCHEMA = "aid_id long, common_mistakes string, mnemonics_memory_aids string, flashcards string"


def groups(spark, rows, columns=COLUMNS):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "1 as id", "0 as part")
    return {(r["first_id"], r["id"]) for r in cp.copy_groups(frame, columns, "aid_id").collect()}


def test_writing_does_not_matter_but_content_does(spark):
    a = json.dumps([{"front": "Lift – of a wing (at 3.50 kN)?", "back": "It's “-2.5”!"}])
    b = json.dumps([{"back": "its - \n -2.5", "front": "LIFT of  a wing at 3.50 kN"}], indent=2)
    others = [a.replace("3.50", "35.0"), a.replace("-2.5", "2.5"), a.replace("front", "top"), a.replace("3.50", "3 50"), json.dumps([*json.loads(a), {}])]
    rows = [(9, a, None, None), (4, b, None, None), *[(20 + i, o, None, None) for i, o in enumerate(others)], (30, None, a, None)]
    assert groups(spark, rows) == {(4, 4), (4, 9)} | {(i, i) for i in (20, 21, 22, 23, 24, 30)}


def test_list_order_nulls_and_unreadable(spark):
    rows = [(1, '["a","b"]', None, None), (2, '["b","a"]', None, None), (3, None, None, None), (4, None, None, None), (5, "[broken", None, "x"), (6, "Broken!", None, "X."), (7, "", None, None), (8, "[]", None, None)]
    assert groups(spark, rows) == {(1, 1), (2, 2), (3, 3), (3, 4), (5, 5), (5, 6), (7, 7), (8, 8)}
    assert groups(spark, rows[:1]) == {(1, 1)}


def test_nothing_and_long_texts(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert cp.copy_groups(frame, COLUMNS, "aid_id").count() == 0
    long = json.dumps(["word " * 40_000])
    assert groups(spark, [(1, long, None, None), (2, long.upper(), None, None)]) == {(1, 1), (1, 2)}


def test_a_huge_group_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(i, json.dumps(["same" if i % 3 == 0 else f"own {r.randint(0, 400)}"]), None, None) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = groups(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = {}
    for i, text, *_ in rows:
        first.setdefault(text, i)
    assert got == {(first[t], i) for i, t, *_ in rows}


def test_counts(spark):
    frame = spark.range(10).select(F.col("id").alias("aid_id"), F.concat(F.lit('["'), (F.col("id") % 2).cast("string"), F.lit('"]')).alias("c"))
    assert sorted(tuple(r) for r in cp.collapsed(frame, ["c"], "aid_id").collect()) == [(0, 5), (1, 5)]
