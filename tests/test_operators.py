import json
import math
import random

import pytest
from pyspark.sql import functions as F

from concordat.functions import casts, text, vectors
from concordat.operators import components, consensus, evaluation, graph, records, retrieval, similarity, telemetry, validation
from concordat.provider import ask, fan_out, with_retries


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    low = {}
    for x in parent:
        low[find(x)] = min(x, low.get(find(x), x))
    return sorted((x, low[find(x)]) for x in parent)


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long"))
    assert rows_of(got, "node", "component") == sorted({*brute_components(edges)})


def test_components_of_a_star_and_of_nothing(spark):
    star = spark.range(1, 500).selectExpr("0L as src", "id as dst")
    assert components.connected_components(star).where("component <> 0").count() == 0
    assert components.connected_components(star.limit(0)).count() == 0


def test_weighted_average_of_the_worked_example(spark):
    rows = spark.createDataFrame([("q", 5.0, 0.5), ("q", 10.0, 0.3), ("q", 0.0, 0.2), ("q", None, 0.9), ("z", 1.0, 0.0)], "q string, v double, w double")
    assert rows_of(consensus.weighted_average(rows, ["q"], "v", "w"), "q", "average")[0] == ("q", 5.5)


def test_votes_thresholds_and_ties(spark):
    rows = spark.createDataFrame([("q", "B", 0.5), ("q", "A", 0.5), ("r", "A", 0.8), ("r", "B", 0.2), ("s", None, 1.0)], "q string, v string, w double")
    got = {r["q"]: (r["winner"], r["status"]) for r in consensus.weighted_vote(rows, ["q"], "v", "w").collect()}
    assert got == {"q": ("A", "disputed"), "r": ("A", "accepted"), "s": (None, "disputed")}
    assert rows_of(consensus.majority(rows, ["q"], "v"), "q", "v", "votes") == [("q", "A", 1), ("r", "A", 1)]


def test_red_line_needs_a_clear_no(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("b", False)], "q string, ok boolean")
    assert rows_of(consensus.red_line(rows, ["q"], "ok"), "q", "red_line") == [("a", False), ("b", True)]


@pytest.mark.parametrize(("n", "sizes"), [(3, [3]), (7, [3, 4]), (13, [5, 5, 3]), (24, [5, 5, 5, 5])])
def test_dispute_batches(spark, n, sizes):
    rows = consensus.dispute_batches(spark.range(n).selectExpr("1 as q", "id"), ["q"], "id")
    assert [c for _, c in rows_of(rows.where("batch is not null").groupBy("batch").count(), "batch", "count")] == sizes
    assert rows.where("status = 'unprocessed'").count() == max(0, n - 20)


def test_quality_score_of_the_stored_record(spark):
    score = consensus.quality_score(F.lit(0.75), F.lit(0.9), F.lit(2), F.lit(0.489), F.lit(0.0))
    assert abs(spark.range(1).select(score.alias("s")).first()["s"] - 0.67085) < 1e-9


def test_sign_test_and_effect_of_the_stored_report(spark):
    frame = spark.createDataFrame([(2483, 2358, 550)], "w long, l long, t long")
    z = evaluation.sign_z(F.col("w"), F.col("l"))
    row = frame.select(evaluation.two_sided_p(z).alias("p"), evaluation.effect_size(F.col("w"), F.col("l"), F.col("t")).alias("d")).first()
    assert round(row["p"], 4) == 0.0724 and round(row["d"], 2) == 0.05


def test_label_metrics_of_the_stored_sheet(spark):
    rows = spark.range(428).selectExpr("id < 402 as ok", "id = 427 as wrong", "'c' as c", "4.75 as r")
    got = evaluation.label_metrics(rows, "c", F.col("ok"), F.col("wrong"), F.col("r")).where("c is null").first()
    assert round(got["precision"] * 100, 2) == 93.93 and round(got["hallucination_rate"] * 100, 2) == 0.23


def test_bootstrap_interval_covers_the_mean(spark):
    rows = spark.range(2000).selectExpr("id % 2 as k", "cast(id % 10 as double) as v", "id")
    for r in evaluation.bootstrap_interval(rows, ["k"], "v").collect():
        assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 0.6


def test_fusion_is_symmetric_and_hand_checked(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, d string, rank int")
    two = spark.createDataFrame([("q", "a", 1), ("q", "c", 2)], "q string, d string, rank int")
    left, right = (retrieval.fuse(x, y, "q", "d").select("d", "hybrid_score") for x, y in ((one, two), (two, one)))
    assert dict(rows_of(left, "d", "hybrid_score")) == dict(rows_of(right, "d", "hybrid_score"))
    assert abs(dict(rows_of(left, "d", "hybrid_score"))["a"] - 2 / 61) < 1e-12


def test_nearest_matches_brute_force_over_many_blocks(spark):
    r = random.Random(1)
    data = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(200)] + [(900, [0.0] * 4)]
    frame = spark.createDataFrame(data, "id long, v array<float>")
    got = retrieval.nearest(frame.where("id % 20 = 0"), frame, "id", "v", 3, most_shared=200)

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for q, v in data:
        if q % 20 == 0:
            want = sorted(((-round(cos(v, w), 8), i) for i, w in data if i != q))[:3]
            assert [i for _, i in want] == [x["id"] for x in got.where(f"query_id = {q}").orderBy("rank").collect()]


def test_bm25_prefers_more_matches_and_ignores_nothing_else(spark):
    docs = spark.createDataFrame([(1, "lift drag lift"), (2, "lift"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "the lift and drag"), ("z", None)], "q string, t string")
    got = rows_of(retrieval.top_k(retrieval.bm25(asked, docs, "q", "t", "doc_id", "text"), "q", "score", "doc_id", 5), "q", "doc_id", "rank")
    assert got == [("q", 1, 1), ("q", 2, 2)]


def test_text_functions(spark):
    got = spark.createDataFrame([(" Ünder  the_Wing, 3.5!",), (None,), ("",)], "t string").select(text.tokens("t").alias("k"), text.normalised("t").alias("n"), text.sentences("t").alias("s")).collect()
    assert got[0]["k"] == ["ünder", "the_wing", "3", "5"] and got[0]["n"] == "nder thewing 35" and got[0]["s"] == ["Ünder  the_Wing, 3", "5"]
    assert got[1]["k"] == [] and got[2]["k"] == []


def test_casts_and_vectors(spark):
    row = spark.createDataFrame([("3.7", "x", "Yes", [3.0, 4.0])], "a string, b string, c string, v array<double>").select(
        casts.safe_int(F.col("a")).alias("i"), casts.safe_int(F.col("b"), 9).alias("j"), casts.safe_bool(F.col("c")).alias("k"), vectors.norm("v").alias("n"),
        vectors.cosine("v", F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
    ).first()
    assert tuple(row) == (3, 9, True, 5.0, 0.0)


def test_similarity_groups_and_merging(spark):
    rows = spark.createDataFrame([("q", "The lift grows.", 0.5), ("q", "the lift grows", 0.2), ("q", "drag falls", 0.3), ("q", None, 1.0)], "q string, t string, w double")
    got = similarity.agreement(rows, ["q"], "t", "w").first()
    assert got["n_groups"] == 2 and abs(got["consensus_score"] - 0.7) < 1e-9
    texts = spark.createDataFrame([("q", "The lift grows. One thing.", 0.5), ("q", "the lift grows! Another thing here.", 0.2)], "q string, t string, w double")
    assert similarity.merged_sentences(texts, ["q"], "t", "w").first()["merged"] == "The lift grows."
    assert similarity.ratio("", "a") == 0.0 and round(similarity.ratio(similarity.plain("abcd"), similarity.plain("bcde")), 2) == 0.75


def test_leaves_and_paths(spark):
    assert {p: v for p, _, v in records.leaf_paths({"a.b": [1, {"c": []}], "d": None})} == {"`a.b`[0]": "1", "`a.b`[1].c": "[]", "d": "null"}
    frame = spark.createDataFrame([('{"a": [1]}', '"x"'), ("bad", '"x"')], "j string, n string")
    assert [r["j"] for r in records.with_path(frame, "j", ["a", 2, "k"], "n").collect()] == ['{"a": [1, null, {"k": "x"}]}', "bad"]


def test_violations(spark):
    record = {
        "question_id": "q", "exam_name": "e", "subject": None, "year": 1, "question_text": "t",
        "tier_0_classification": {"content_type": "odd", "media_type": None, "difficulty_score": 11, "complexity_flags": {"ambiguous_wording": 1}, "use_gpt51": True, "classification_confidence": 1, "weight_strategy": "BALANCED"},
        "tier_1_core_research": {"hierarchical_tags": {"subject": {}, "topic": None, "concepts": [{"name": "n", "importance": 5}, "x", None, {"name": None}]}, "difficulty_analysis": {"overall": None, "score": True}},
        "tier_2_student_learning": {"flashcards": [], "common_mistakes": {}}, "tier_3_enhanced_learning": [],
    }
    rows = [(1, json.dumps(record)), (2, "{"), (3, None), (4, "[]")]
    got = {(r["response_id"], r["check"], r["path"]) for r in validation.violations(spark.createDataFrame(rows, "response_id long, j string"), "response_id", "j").collect()}
    t0, t1, t2 = "tier_0_classification", "tier_1_core_research", "tier_2_student_learning"
    want = {
        (2, "json", "$"), (4, "json", "$"), (1, "required", "question_type"), (1, "required", "tier_4_metadata_and_future"), (1, "type", "tier_3_enhanced_learning"),
        (1, "enum", f"{t0}.content_type"), (1, "null", f"{t0}.media_type"), (1, "enum", f"{t0}.media_type"), (1, "range", f"{t0}.difficulty_score"), (1, "type", f"{t0}.classification_confidence"),
        (1, "required", f"{t0}.classification_reasoning"), (1, "type", f"{t0}.complexity_flags.ambiguous_wording"), (1, "required", f"{t0}.complexity_flags.edge_case_scenario"),
        (1, "type", f"{t1}.hierarchical_tags.concepts[0].importance"), (1, "element", f"{t1}.hierarchical_tags.concepts[1]"), (1, "element", f"{t1}.hierarchical_tags.concepts[2]"),
        (1, "required", f"{t1}.hierarchical_tags.concepts[3].importance"), (1, "enum", f"{t1}.difficulty_analysis.overall"), (1, "type", f"{t2}.common_mistakes"), (1, "required", f"{t2}.exam_strategy"),
    }
    assert want <= got
    assert not {g for g in got if g[2] in (f"{t1}.hierarchical_tags.topic", f"{t1}.difficulty_analysis.score", f"{t0}.use_gpt51", "subject")}


def test_telemetry_boundaries(spark):
    calls = spark.sql("select * from values ('m', timestamp '2024-01-01 00:00:00', 60.0D), ('m', timestamp '2024-01-01 01:00:00', 30.0D), ('m', timestamp '2024-01-01 01:00:01', 10.0D) t(m, ts, c)")
    assert [r["trailing_calls"] for r in telemetry.trailing_calls(calls, "m", "ts").orderBy("ts").collect()] == [1, 2, 2]
    got = rows_of(telemetry.budget_crossings(calls, "m", ["ts"], "c", 100.0, "ts"), "mark")
    assert [m for (m,) in got] == [0.75, 0.9, 1.0]


def test_graph_ranks_sum_to_one(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "b")], "source string, target string")
    ranks = {r["node"]: r["rank"] for r in graph.page_rank(edges, 5).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] == max(ranks.values())
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()} == {"a": 3, "b": 3, "c": 2}


def test_provider_errors_stay_in_their_row(spark):
    def flaky(model, prompt):
        if model == "bad":
            raise ValueError("no")
        return prompt.upper(), 1, 1

    requests = fan_out(spark.createDataFrame([("q", "hi")], "id string, p string"), ["good", "bad"], "id", "p")
    got = {r["model"]: (r["text"], r["error"]) for r in ask(requests, flaky).collect()}
    assert got == {"good": ("HI", None), "bad": (None, "no")}
    tries = []

    def third(model, prompt):
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok", 0, 0

    assert with_retries(third, delay=0)("m", "p")[0] == "ok"


def test_similar_pairs_are_those_of_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    bank = "lift drag wing tail flow plate shear load grows falls the of with until small large".split()
    texts = [" ".join(r.choice(bank) for _ in range(r.randint(4, 9))) for _ in range(40)]
    texts = sorted({*texts, *[t + " again" for t in texts], *[t.replace("wing", "tail") for t in texts]})
    rows = [(i, i // 70, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, g int, p string")
    got = {(x["a"], x["b"]) for x in similarity.similar_pairs(frame, ["g"], "id", "p", 0.8).collect()}
    words = lambda t: set(t.split())
    want = {
        (i, j) for (i, g, a), (j, h, b) in itertools.combinations(rows, 2)
        if g == h and len(words(a) & words(b)) / len(words(a) | words(b)) >= 0.7 - 1e-9 and similarity.ratio(a, b) >= 0.8
    }
    assert got == want and len(want) > 10


def test_items_that_repeat_go(spark):
    rows = [("a", 0, "The lift of the thin wing grows with speed."), ("a", 1, "the lift of the thin wing grows with speed"), ("a", 2, "Then the drag falls"), ("a", 3, None), ("a", 4, "The lift of the thin wings grows with speed!"), ("b", 0, "the lift of the thin wing grows with speed"), ("b", 1, " ")]
    got = similarity.distinct_items(spark.createDataFrame(rows, "k string, pos int, t string"), ["k"], "pos", "t")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0), ("a", 2), ("b", 0)]
    assert similarity.distinct_items(spark.createDataFrame([], "k string, pos int, t string"), ["k"], "pos", "t").count() == 0
