"""The whole path of a question: context, answers of several models, vote, second round on the disputed ones, record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.functions.casts import tolerant_json
from concordat.operators import consensus as cs
from concordat.operators import retrieval as rt
from concordat.provider import Provider, ask, fan_out, stand_in
from concordat.runtime import cut_lineage


def context_of(questions: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """``(question_id, context)``: snippets of the best documents of each question, in order of rank."""
    best = rt.bm25_best(questions, documents, "question_id", "question_text", "doc_id", "text", k)
    named = best.join(documents.select("doc_id", tx.snippet("text").alias("snippet")), "doc_id")
    entries = F.array_sort(F.collect_list(F.struct("rank", "snippet")))
    return named.groupBy("question_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(F.lit("["), e["rank"].cast("string"), F.lit("] "), e["snippet"])), "\n").alias("context"))


def _votes(requests: DataFrame, answers: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(w))])
    said = F.try_variant_get(tolerant_json(F.col("text")), "$.answer", "string")
    return requests.select("request_id", "question_id").join(answers, "request_id").select(
        "question_id", "model", said.alias("answer"), F.element_at(weight, F.col("model")).alias("weight"), "input_tokens", "output_tokens"
    )


def answer_questions(
    questions: DataFrame, documents: DataFrame, weights: dict[str, float], tiebreaker: str, provider: Provider = stand_in, threshold: float = 0.7
) -> DataFrame:
    """``(question_id, answer, status, rounds, calls, input_tokens, output_tokens)`` of every question.

    Models are asked once each, their answers voted on by weight; disputed questions
    go round again with one more model at 0.3 of all weight. What stays disputed has
    the heavier answer and says so.
    """
    prompts = questions.join(cut_lineage(context_of(questions, documents)), "question_id", "left").withColumn(
        "prompt", tx.fill_template("Question: {question}\nContext:\n{context}", {"question": F.col("question_text"), "context": F.col("context")})
    )
    first = cut_lineage(fan_out(prompts, list(weights), "question_id", "prompt"))
    votes = cut_lineage(_votes(first, ask(first, provider), weights))
    round_one = cut_lineage(cs.weighted_vote(votes, ["question_id"], "answer", "weight", threshold))
    open_ = round_one.where("status = 'disputed'").select("question_id")
    again = cut_lineage(fan_out(prompts.join(open_, "question_id", "left_semi"), [tiebreaker], "question_id", "prompt"))
    extra = _votes(again, ask(again, provider), {tiebreaker: 0.3})
    scaled = votes.join(open_, "question_id", "left_semi").withColumn("weight", F.col("weight") * 0.7 / sum(weights.values()))
    all_votes = cut_lineage(scaled.unionByName(extra))
    round_two = cs.weighted_vote(all_votes, ["question_id"], "answer", "weight", threshold)
    settled = round_one.where("status <> 'disputed'").withColumn("rounds", F.lit(1)).unionByName(round_two.withColumn("rounds", F.lit(2)))
    usage = votes.unionByName(extra).groupBy("question_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return settled.join(usage, "question_id").select("question_id", F.col("winner").alias("answer"), "status", "rounds", "calls", "input_tokens", "output_tokens")


def unprocessed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that no earlier run has finished."""
    return work.join(done.select(key), key, "left_anti")


def progress(done: DataFrame, status: Column, hit: Column) -> DataFrame:
    """One row of run statistics: processed, failed, cache hits and their rate."""
    return done.agg(
        F.count("*").alias("processed"), F.count_if(status == "failed").alias("failed"), F.count_if(hit).alias("hits"), (F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))).alias("hit_rate")
    )
