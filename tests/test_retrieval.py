import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.operators import pipeline, retrieval
from concordat.plans import search


def corpus(spark, n_docs=400, n_queries=60):
    r = random.Random(5)
    bank = [f"term{i}" for i in range(40)]
    docs = [(i, r.choice([None, "", "so the"]) if i % 50 == 0 else " ".join(r.choice(bank) for _ in range(r.randint(1, 12))), i % 3 == 0) for i in range(n_docs)]
    docs += [(7, "term1 term2 term39", True), (None, "term1", True)]
    queries = [(f"q{i}", " ".join(r.choice(bank) for _ in range(r.randint(1, 5)))) for i in range(n_queries)] + [("none", None), ("odd", "the unheard"), ("q1b", "term3 term4"), ("q1c", "term4 Term3!")]
    return spark.createDataFrame(queries, "q string, t string"), spark.createDataFrame(docs, "doc_id long, text string, note boolean").repartition(3)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("q", "doc_id", "rank", F.round("score", 8)).collect())


def test_best_of_each_query_are_those_of_all_scores(spark):
    queries, docs = corpus(spark)
    scored = retrieval.bm25(queries, docs, "q", "t", "doc_id", "text").cache()
    notes = docs.where("note").select("doc_id").distinct()
    want = rows_of(retrieval.top_k(scored, "q", "score", "doc_id", 5)), rows_of(retrieval.top_k(scored.join(notes, "doc_id"), "q", "score", "doc_id", 5))
    for most_shared in (1 << 20, 200):  # in one block and in several
        best = retrieval.bm25_best(queries, docs, "q", "t", "doc_id", "text", 5, F.col("note"), most_shared).cache()
        assert (rows_of(best.where("not marked")), rows_of(best.where("marked"))) == want
    assert retrieval.bm25_best(queries.where("q = 'none'"), docs, "q", "t", "doc_id", "text", 5).count() == 0
    assert retrieval.bm25_best(queries, docs.limit(0), "q", "t", "doc_id", "text", 5).count() == 0


def test_scores_of_all_pairs_are_never_rows(spark):
    queries, docs = corpus(spark, 3000, 40)
    sets = queries.where("t like 'term%'").select(F.split("t", " ").alias("words")).distinct().withColumn("set", F.monotonically_increasing_id())
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.lit(False).alias("marked"), F.coalesce(F.split("text", " "), F.array()).alias("words"))
    kept = retrieval._best_of_words(sets, rows, 5, False)
    assert kept.count() <= 5 * sets.count() * kept.rdd.getNumPartitions() < sets.count() * 3000 / 20


def test_contexts_are_searched_once(spark):
    questions, docs = corpus(spark, 200, 20)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    documents = docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(counted, "doc_id long, text string")
    asked = questions.select(F.col("q").alias("question_id"), F.col("t").alias("question_text"))
    got = pipeline.answer_questions(asked, documents, {"m1": 0.5, "m2": 0.5}, "m3").collect()
    assert len(got) == questions.count() and {r["rounds"] for r in got} == {1, 2}
    assert read.value == 2 * 201  # for their words, and for the snippets of the best


def test_every_question_is_searched_in_every_document(spark, tmp_path):
    r = random.Random(8)
    bank = [f"term{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(bank) for _ in range(n))
    ids = [f"ORBEX_2016_FM_Q{i}" for i in range(1, 45)] + ["no_number", "Q", None, None, "ORBEX_2016_FM_Q7", "Q99999999999"]
    spark.createDataFrame([(i, text(r.randint(1, 6))) for i in ids] + [("Q3x", None), ("Q3y", " ")], "question_id string, question_text string").write.parquet(f"{tmp_path}/question.parquet")
    spark.createDataFrame([(i, text(r.randint(1, 9)) if i % 40 else None) for i in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("question", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = search.agg_03_bm25_topk(spark, str(tmp_path)).collect()
    assert {r["question_id"] for r in got} == set(ids)
    assert Counter(map(tuple, got)) == Counter(con.sql(search.SQL["agg_03_bm25_topk"]).fetchall())
    asked_still = {r["question_id"] for r in search.asked(spark, str(tmp_path)).collect()}
    assert asked_still == {"ORBEX_2016_FM_Q20", "ORBEX_2016_FM_Q40"}


@pytest.mark.parametrize("words, kind", [(12, np.uint16), (300, np.uint32)])
def test_rounded_scores_leave_out_no_best_document(words, kind):
    """Chunks scored one after the other, with equal documents, frequent and rare words, against all scores."""
    draw, k, n_words, n = np.random.default_rng(words), 4, 500, 900
    use = np.minimum(draw.geometric(0.02, (n, 30)) - 1, n_words - 1)
    use[n // 2 :: 3] = use[0]  # posted again
    idf = draw.random(n_words) * 6 + 0.1
    sets = [np.unique(draw.integers(0, n_words, words)) for _ in range(25)]
    ends, of_set = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    unit = max(idf[s].sum() for s in sets) * 2.5 / (np.iinfo(kind).max - words)
    best, every = retrieval._Best(len(sets), k, unit), np.zeros((len(sets), n))
    for start in range(0, n, 100):
        rows, ids = np.repeat(np.arange(100), 30), np.arange(start, start + 100)
        scores = retrieval._Scores(100, np.ones(100), rows, use[start : start + 100].ravel(), idf, unit, kind)
        for q, codes in enumerate(sets):
            near = best.near(q, scores.units_of(codes), len(codes))
            every[q, ids] = scores.of(of_set, ends, np.full(100, q), np.arange(100))
            best.add(np.full(len(near), q), ids[near], scores.of(of_set, ends, np.full(len(near), q), near))
    tf = np.stack([np.bincount(u, minlength=n_words) for u in use])
    weight = idf * tf * 2.5 / (tf + 1.5)
    for q, codes in enumerate(sets):
        assert np.allclose(every[q], weight[:, codes].sum(1))
        assert best.ids[q].tolist() == np.lexsort((np.arange(n), -np.round(every[q], 8)))[:k].tolist()


def test_blocks_of_words_that_are_sent_once(spark):
    queries, docs = corpus(spark)
    sets = queries.where("t like 'term%'").select(F.split("t", " ").alias("words"))
    assert [retrieval._blocks(sets, most) > 1 for most in (1 << 20, 1500, 200)] == [False, True, True]
    got = [rows_of(retrieval.bm25_best(queries, docs, "q", "t", "doc_id", "text", 5, most_shared=most)) for most in (1 << 20, 1500)]
    assert got[0] == got[1]
