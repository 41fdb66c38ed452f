from concordat.plans import voting


def test_every_step_is_compared_by_its_place(spark, tmp_path):
    rows = [("q", ["The lift grows.", "Drag falls"]), ("q", ["the lift grows", None, "Check"]), ("r", None), (None, ["x"])]
    spark.createDataFrame(rows, "question_id string, step_by_step array<string>").write.parquet(f"{tmp_path}/response.parquet")
    got = {(r["question_id"], r["pos"]): (r["consensus_score"], r["n_groups"]) for r in voting.agg_35_text_agreement(spark, str(tmp_path)).collect()}
    assert got == {("q", 0): (1.0, 1), ("q", 1): (1.0, 1), ("q", 2): (1.0, 1)}
