import itertools
import random

import pytest
from pyspark.sql import functions as F

from concordat.llm import queries
from concordat.llm import survivorship as sv
from concordat.runtime import table

COLUMNS = "response_id long, request_id string, question_id string, generated_at timestamp, received_at timestamp, channel string, confidence double, classification_confidence double, model_name string"
DAY = "2025-01-0"


def calls(spark, rows):
    full = [(i, rid, q, f"{DAY}{g} 00:00:00", f"{DAY}{t} 00:00:00" if t else None, ch, c, cc, m) for i, rid, q, g, t, ch, c, cc, m in rows]
    text = COLUMNS.replace("timestamp", "string")
    return spark.createDataFrame(full, text).withColumn("generated_at", F.to_timestamp("generated_at")).withColumn("received_at", F.to_timestamp("received_at"))


@pytest.fixture
def dims(spark):
    return spark.createDataFrame([("api", 1), ("dump", 2)], "channel string, trust_order int"), spark.createDataFrame([("boreal_r1",), ("ondine_7b",)], "model_name string")


def found(rows, dims):
    best = sv.best_representatives(sv.trusted_calls(rows, *dims), "call", sv.response_bundles(F.col("canonical_model").isNotNull()), sv.Trust("trust_order", "received_at", "response_id"))
    return {(r["first_id"], k): v for r in best.where("n_rows > 1").collect() for k, v in r["kept"].items()}


def test_fields_come_from_the_most_trusted_usable_row(spark, dims):
    rows = [
        (1, " RQ-1", "q", 1, 1, "dump", 0.5, 0.9, "Boreal R1"),
        (2, "rq-1 ", "q", 1, 2, "api", 97.0, None, "unknown"),
        (3, "rq-1", "z", 5, 3, "dump", float("nan"), 0.2, "ondine/7b"),
        (4, None, "z", 5, None, "nowhere", 0.1, 0.3, None),
    ]
    got = found(calls(spark, rows).selectExpr("*", "'x' as call", "5 as trust_order", "1 as component"), dims)
    assert got == {(1, "confidence"): 1, (1, "classification_confidence"): 3, (1, "model_name"): 3}


def test_nulls_blanks_ties_and_nothing(spark, dims):
    rows = [(5, "", None, 1, 1, "api", 0.1, 0.1, "boreal_r1"), (6, " ", None, 1, 1, "api", 0.1, 0.1, "boreal_r1"), (7, None, "q", 2, None, None, 0.1, -1.0, None), (8, None, "q", 2, None, None, 0.1, 2.0, None)]
    assert found(calls(spark, rows), dims) == {(7, "confidence"): 7}
    assert found(calls(spark, rows).limit(0), dims) == {}


def test_a_chain_of_keys_is_one_call(spark, dims):
    rows = [(i, f"r{i // 2}", f"q{(i + 1) // 2}", 1, 1, "api", 0.5, 0.5, "boreal_r1") for i in range(20)]
    assert {k[0] for k in found(calls(spark, rows), dims)} == {0}


@pytest.mark.parametrize("seed", range(4))
def test_branch_and_bound_finds_the_best_combination(seed):
    r = random.Random(seed)
    options = [[{"k": {"o": r.randint(0, 3), "t": r.randint(0, 3), "id": 10 * n + i}, "v": [r.choice(["a", "b", None])]} for i in range(4)] for n in range(3)]
    sides = [(0, 0, 1, 0), (1, 0, 2, 0)]

    def cost(pick):
        total = [0, 0, 0, 0]
        for c in pick:
            add = (1, 0, 0, 0) if c is None else (0, c["k"]["o"], c["k"]["t"], c["k"]["id"])
            total = [x + y for x, y in zip(total, add)]
        return tuple(total)

    def agrees(pick):
        return all(pick[a] is None or pick[b] is None or None in (pick[a]["v"][i], pick[b]["v"][j]) or pick[a]["v"][i] == pick[b]["v"][j] for a, i, b, j in sides)

    best = min((p for p in itertools.product(*[[*o, None] for o in options]) if agrees(p)), key=cost)
    assert sv.branch_and_bound(options, sides) == [None if c is None else c["k"]["id"] for c in best]


def test_dependent_bundles_agree(spark):
    rows = spark.createDataFrame([("g", 1, 1, "a", None), ("g", 2, 2, None, "b"), ("g", 3, 3, "b", "b"), ("h", 1, 9, "a", "a")], "g string, o int, id long, x string, y string").withColumn("t", F.lit(None).cast("timestamp"))
    bundles = [sv.Bundle("x", ("x",), F.col("x").isNotNull()), sv.Bundle("y", ("y",), F.col("y").isNotNull())]
    got = sv.best_representatives(rows, "g", bundles, sv.Trust("o", "t", "id"), [sv.Dependency("x", "x", "y", "y")])
    assert {r["g"]: dict(r["kept"]) for r in got.collect()} == {"g": {"x": 3, "y": 2}, "h": {"x": 9, "y": 9}}


def test_records_of_the_test_table(spark, sf_dir):
    records = queries.p1_records(spark, sf_dir)
    assert records.count() == records.select("first_response_id").distinct().count() > 0


def test_groups_of_the_test_table_branch(spark, sf_dir):
    """Free choices differ in their channel somewhere, and the kept ones nowhere do."""
    calls = sv.trusted_calls(table(spark, sf_dir, "response"), table(spark, sf_dir, "ingest_channel"), table(spark, sf_dir, "model_price"))
    bundles, trust = sv.response_bundles(F.col("canonical_model").isNotNull()), sv.Trust("trust_order", "received_at", "response_id")
    tie = [sv.Dependency("confidence", "channel", "classification_confidence", "channel")]
    channel = {r["response_id"]: r["channel"] for r in calls.select("response_id", "channel").collect()}

    def broken(best):
        pairs = [(r["kept"].get("confidence"), r["kept"].get("classification_confidence")) for r in best.collect()]
        return sum(None not in (a, b) and None not in (channel[a], channel[b]) and channel[a] != channel[b] for a, b in pairs)

    assert broken(sv.best_representatives(calls, "call", bundles, trust)) > 0
    assert broken(sv.best_representatives(calls, "call", bundles, trust, tie)) == 0
