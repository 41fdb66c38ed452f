import random

from concordat.llm import annotators as an

SCHEMA = "question_id string, model_name string, content_type string, difficulty_score int, weight_strategy string"


def usable(spark, rows):
    schema = an.label_schema(spark, {"content_type": ["a_b", "c"], "difficulty_score": an.DIFFICULTIES})
    prices = spark.createDataFrame([("m_1",)], "model_name string")
    frame = spark.createDataFrame(rows, SCHEMA).drop("weight_strategy").selectExpr("*", "'x' as label", "1 as l")
    return schema, an.usable_votes(frame, schema, prices)


def test_usable_votes(spark):
    rows = [("q", "M 1", "A-B", 3, None), ("q", "m_1\t", "a b", 3, None), ("q", "other", "mixed", 11, None), ("q", None, "c", 1, None), (None, "m_1", "c", 1, None), ("q", "m_1", None, -1, None)]
    _, votes = usable(spark, rows)
    assert sorted(tuple(r) for r in votes.collect()) == [("content_type", "q", "m_1", 0), ("difficulty_score", "q", "m_1", 2)]


def test_truth_is_recovered_where_the_majority_is_wrong(spark):
    r = random.Random(5)
    truth = {f"q{i}": r.randint(0, 3) for i in range(400)}
    votes = []
    for q, t in truth.items():
        votes += [(q, a, t if r.random() < 0.93 else r.randint(0, 3)) for a in ("good1", "good2")]
        votes += [(q, a, (t + 1) % 4 if r.random() < 0.8 else r.randint(0, 3)) for a in ("shift1", "shift2", "shift3")]
        if r.random() < 0.05:
            votes.append((q, "rare", t))
    frame = spark.createDataFrame([("f", q, a, v) for q, a, v in votes], "field_name string, question_id string, annotator string, l int")
    items, annotators = an.fit_communities(frame, {"f": 4})
    schema = an.label_schema(spark, {"f": list("0123")})
    got = {x["question_id"]: int(x["label"]) for x in an.consensus(items, schema).collect()}
    assert len(got) == 400
    right = sum(got[q] == t for q, t in truth.items()) / 400
    trust = {x["annotator"]: x["reliability"] for x in annotators.collect()}
    assert right > 0.9 or right < 0.1  # a shift that most annotators share can stand for the truth
    assert abs(trust["good1"] - trust["good2"]) < 0.1 and abs(trust["shift1"] - trust["shift2"]) < 0.1
    assert min(trust.values()) >= 0 and max(trust.values()) <= 1


def test_better_than_the_majority_among_noise(spark):
    r = random.Random(6)
    truth = {f"q{i}": r.randint(0, 3) for i in range(300)}
    votes = [("f", q, a, t if r.random() < p else r.randint(0, 3)) for q, t in truth.items() for a, p in (("g1", 0.9), ("g2", 0.9), ("b1", 0.1), ("b2", 0.1), ("b3", 0.1))]
    frame = spark.createDataFrame(votes, "field_name string, question_id string, annotator string, l int").distinct()
    items, annotators = an.fit_communities(frame, {"f": 4})
    got = {x["question_id"]: x["p"].index(max(x["p"])) for x in items.collect()}
    majority = {}
    for _, q, _, v in votes:
        majority.setdefault(q, []).append(v)
    base = sum(max(sorted(set(v)), key=v.count) == truth[q] for q, v in majority.items())
    assert sum(got[q] == t for q, t in truth.items()) > base
    trust = {x["annotator"]: x["reliability"] for x in annotators.collect()}
    assert min(trust["g1"], trust["g2"]) > max(trust["b1"], trust["b2"], trust["b3"])


def test_nothing_and_agreement(spark):
    schema, votes = usable(spark, [("q", "m_1", "c", None, None), ("q", "x", "c", None, None), ("q", "y", "a_b", None, None), ("z", "x", "c", None, None)])
    items, annotators = an.fit_communities(votes.limit(0), {"content_type": 2, "difficulty_score": 10})
    assert items.count() == 0 and annotators.count() == 0
    items, _ = an.fit_communities(votes, {"content_type": 2, "difficulty_score": 10})
    rows = {r["question_id"]: r for r in an.consensus(items, schema).collect()}
    assert set(rows) == {"q"} and rows["q"]["label"] == "c" and abs(rows["q"]["agreement"] - 1 / 3) < 1e-9


def test_joined_matrices_give_the_same_and_the_fit_settles(spark):
    r = random.Random(8)
    votes = [("f", f"q{i}", f"a{j}", (i % 4) if r.random() < 0.3 + 0.1 * j else r.randint(0, 3)) for i in range(60) for j in range(6) if r.random() < 0.8]
    frame = spark.createDataFrame(votes, "field_name string, question_id string, annotator string, l int").distinct()
    fits = [an.fit_communities(frame, {"f": 4}, most_shared=n, rounds=12, tolerance=0.05) for n in (1 << 20, 0)]
    rows = [{x["question_id"]: [round(v, 5) for v in (*x["p"], x["agreement"])] for x in items.collect()} for items, _ in fits]
    assert rows[0] == rows[1]
    trust = [{x["annotator"]: (round(x["reliability"], 5), x["type"], x["n_votes"]) for x in annotators.collect()} for _, annotators in fits]
    assert trust[0] == trust[1]
    assert an.fit_communities(frame, {"f": 4})[1].first()["last_change"] < 1e-3
