import json

from pyspark.sql import functions as F

from concordat.operators import annotations as ao
from concordat.operators import records


def test_field_consensus_over_nulls_ties_and_nothing(spark):
    schema = "q string, ok boolean, kind string, n double, w double, red_line string"
    rows = [("a", True, "y", 2.0, 0.5, ""), ("a", False, "x", None, 0.5, ""), ("a", None, None, 6.0, 1.5, ""), ("b", None, None, None, None, ""), ("c", True, "x", 1.0, 0.0, "")]
    frame = spark.createDataFrame(rows, schema)
    got = {r["q"]: (r["red_line"], r["kind"], r["n"], r["n_disputed"]) for r in ao.field_consensus(frame.drop("red_line"), ["q"], F.col("ok"), ["kind"], ["n"], F.col("w")).collect()}
    assert got == {"a": (True, "x", 5.0, 1), "b": (False, None, None, 0), "c": (False, "x", None, 0)}
    assert ao.field_consensus(frame.limit(0), ["q"], F.col("ok"), ["kind"], ["n"], F.col("w")).count() == 0


def brute(data):
    total = filled = 0
    for v in data.values():
        if isinstance(v, dict):
            t, n = brute(v)
            total, filled = total + t, filled + n
        elif isinstance(v, list):
            total, filled = total + 1, filled + any(x is not None for x in v)
        else:
            total, filled = total + 1, filled + (v is not None and v != "")
    return total, filled


def test_completeness_is_that_of_a_plain_walk(spark):
    bodies = [
        {"a": 1, "b": {"c": None, "d": "", "e": {}}, "f": [], "g": [None], "h": [None, {"x": None}], "i": [[1]], "j.k": [1, 2], "l": 0, "m": False},
        {"a": None}, {"h": [{}]}, {"deep": {"er": {"list": [{"a": None}, None], "t": "x"}}},
    ]
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "{"), (10, None)], "id long, body string")
    got = {r["id"]: (r["fields"], r["filled"]) for r in ao.completeness(records.flattened(frame, "id", "body"), "id").collect()}
    assert got == {i: brute(b) for i, b in enumerate(bodies)}


def test_metrics_count_only_what_is_there(spark):
    body = {"tier_1_core_research": {"explanation": {"step_by_step": ["a", None, "b"], "formulas_used": "x"}, "answer_validation": {"reasoning": "four", "confidence": "0.5"}, "difficulty_analysis": {"score": 7}}}
    r = ao.record_metrics(spark.createDataFrame([(1, json.dumps(body)), (2, "no"), (3, None)], "id long, body string"), "id", "body").collect()
    assert len(r) == 1 and (r[0]["step_by_step"], r[0]["formulas_used"], r[0]["text_length"], r[0]["confidence"], r[0]["score"], r[0]["n_items"]) == (2, 0, 4, None, 7.0, 2)


def test_small_functions(spark):
    one = spark.createDataFrame([("a.b[0].c", "so {\"winner\": \"B\"} it is", None, "x" * 70)], "p string, reply string, none string, long string")
    got = one.select(
        ao.field_key(F.col("p")).alias("k"), ao.judge_reply(F.col("reply")).alias("w"), ao.judge_reply(F.col("none")).alias("n"), ao.shown(F.col("none")).alias("m"),
        F.length(ao.shown(F.col("long"))).alias("l"), ao.reference(F.lit("Book"), F.col("p"), F.col("none"), F.lit(" ")).alias("r"), ao.template_problems(F.lit("{b} {c} }"), ["a", "b"]).alias("t"),
    ).first()
    assert (got["k"], got["w"], got["n"], got["m"], got["l"], got["r"]) == ("a_b_0_c", "B", None, "[EMPTY/MISSING]", 63, "Book: a.b[0].c")
    assert (got["t"]["undeclared"], got["t"]["unused"], got["t"]["balanced"]) == (["c"], ["a"], False)


def test_samples_budgets_and_progress(spark):
    frame = spark.range(40).selectExpr("id", "id % 3 as g", "if(id = 9, null, 10.0D) as c")
    first = sorted(tuple(r) for r in ao.seeded_sample(frame, "g", "id", 4, 1).collect())
    assert first == sorted(tuple(r) for r in ao.seeded_sample(frame.repartition(7), "g", "id", 4, 1).collect()) and len(first) == 12
    kept = {g: [r["id"] for r in ao.affordable(frame, "g", ["id"], "c", 45.0).where(f"g = {g}").collect()] for g in range(3)}
    assert [len(v) for v in kept.values()] == [5, 4, 4]
    done = ao.resume_info(frame, frame.where("id < 12"), ["id"], "g").orderBy("g").collect()
    assert [(r["total"], r["done"], r["remaining"]) for r in done] == [(14, 4, 10), (13, 4, 9), (13, 4, 9)]
    eta = {r["id"]: r["eta"] for r in ao.remaining_time(frame, "g", ["id"], "c").collect()}
    assert eta[0] == 130.0 and eta[39] == 0.0
