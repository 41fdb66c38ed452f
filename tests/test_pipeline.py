import json

from pyspark.sql import functions as F

from concordat.operators import consensus, pipeline, silver

RECORD = {
    "tier_0_classification": {"content_type": "conceptual_theory", "difficulty_score": 3},
    "tier_1_core_research": {
        "hierarchical_tags": {"subject": {"name": "Flight"}, "topic": {"name": "Lift"}, "concepts": [{"name": "drag"}, {"name": " "}]},
        "prerequisites": {"essential": ["algebra"], "helpful": None, "dependency_tree": {"drag": ["requires: flow", "enables: glide", "other"]}},
        "explanation": {"formulas_used": ["$F = m$"]},
    },
}


def test_records_come_out_of_their_wrapping_and_name_their_graph(spark):
    text = json.dumps(RECORD)
    rows = [(1, "q", text), (2, "q", f"```json\n{text}\n```"), (3, "q", json.dumps([RECORD])), (4, "q", json.dumps({"response_json": RECORD})), (5, "q", text[:40]), (6, None, None)]
    typed = silver.silver(spark.createDataFrame(rows, "response_id long, question_id string, j string"), "j")
    assert sorted(r["response_id"] for r in typed.where("tier_0_classification.difficulty_score = 3").collect()) == [1, 2, 3, 4]
    edges = {(r["source"], r["edge_type"], r["target"]) for r in silver.knowledge_edges(typed.where("response_id = 1")).collect()}
    assert edges == {
        ("Lift", "PART_OF", "Flight"), ("q", "TESTS", "drag"), ("drag", "BELONGS_TO", "Lift"), ("q", "REQUIRES", "algebra"), ("drag", "REQUIRES", "flow"),
        ("drag", "ENABLES", "glide"), ("q", "USES_FORMULA", "F = m"), ("q", "HAS_DIFFICULTY", "3"),
    }
    nodes = silver.knowledge_nodes(silver.knowledge_edges(typed))
    assert {r["node_id"]: r["n"] for r in nodes.where("node_type = 'topic'").collect()} == {"Lift": 8}


def test_questions_are_voted_on_and_disputes_go_round_again(spark):
    def provider(model, prompt):
        answer = "A" if "easy" in prompt else {"m1": "B", "m2": "C", "m3": "B"}[model]
        return json.dumps({"answer": answer}), 10, 1

    questions = spark.createDataFrame([("easy", "an easy lift question"), ("hard", "a hard drag question"), ("none", None)], "question_id string, question_text string")
    documents = spark.createDataFrame([(1, "lift is easy to see"), (2, None)], "doc_id long, text string")
    got = {r["question_id"]: r for r in pipeline.answer_questions(questions, documents, {"m1": 0.5, "m2": 0.5}, "m3", provider, 0.6).collect()}
    assert (got["easy"]["answer"], got["easy"]["status"], got["easy"]["rounds"], got["easy"]["calls"]) == ("A", "accepted", 1, 2)
    assert (got["hard"]["answer"], got["hard"]["status"], got["hard"]["rounds"], got["hard"]["calls"]) == ("B", "accepted", 2, 3)
    assert set(got) == {"easy", "hard", "none"}


def test_small_rules(spark):
    rows = spark.createDataFrame([("A", True), ("B", True), ("x", False), ("b", False)], "w string, s boolean")
    assert [r[0] for r in rows.select(consensus.swapped_back(F.col("w"), F.col("s"))).collect()] == ["B", "A", "TIE", "B"]
    statuses = spark.createDataFrame([(74.9,), (75.0,), (90.0,), (100.0,)], "c double").select(consensus.budget_status(F.col("c"), 100.0))
    assert [r[0] for r in statuses.collect()] == ["OK", "WARNING", "CRITICAL", "EXCEEDED"]
    values = spark.createDataFrame([("q", "x", 3), ("q", "y", 1), ("q", "", 0), ("q", None, 0)], "q string, v string, o int")
    assert [tuple(r) for r in consensus.merged_value(values, ["q"], "v", "o").collect()] == [("q", "y")]
