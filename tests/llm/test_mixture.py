from concordat.llm import mixture as mx

SCHEMA = "doc_id long, source string, n_tokens long"


def docs(spark):
    big = [(i, "big", 50 + i % 40) for i in range(6000)]
    small = [(10_000 + i, "small", 30 + i % 10) for i in range(200)]
    odd = [(20_000, None, 5), (20_001, "other", 9), (20_002, "big", 0), (20_003, "big", None)]
    return spark.createDataFrame(big + small + odd, SCHEMA).selectExpr("*", "1 as copies", "2 as n", "3 as part")


def targets(spark, rows=(("big", 0.75, 1), ("small", 0.25, 4), ("absent", 0.1, 2), (None, 0.1, 1))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    mixture = mx.draw_mixture(docs(spark), targets(spark))
    report = {r["source"]: r for r in mx.mixture_report(mixture, docs(spark), targets(spark)).collect()}
    assert abs(report["big"]["actual_share"] - 0.75) < 0.01 and abs(report["small"]["actual_share"] - 0.25) < 0.01
    assert report["small"]["most_uses"] <= 4 and report["big"]["most_uses"] == 1 and report["absent"]["n_uses"] == 0
    again = mx.draw_mixture(docs(spark), targets(spark))
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, again.collect()))


def test_every_document_is_used_floor_or_ceil_times(spark):
    uses = mx.draw_mixture(docs(spark), targets(spark), total_tokens=20_000).groupBy("source", "doc_id").count().collect()
    plan = {r["source"]: r["copies"] for r in mx.mixture_plan(docs(spark), targets(spark), 20_000).collect()}
    assert all(plan[r["source"]] - 1 < r["count"] < plan[r["source"]] + 1 for r in uses)


def test_nothing(spark):
    assert mx.draw_mixture(docs(spark).limit(0), targets(spark)).count() == 0
    assert mx.draw_mixture(docs(spark), targets(spark).limit(0)).count() == 0
