"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import annotators as an
from concordat.llm import copies as cp
from concordat.llm import mixture as mx
from concordat.llm import residue as rs
from concordat.llm import survivorship as sv
from concordat.llm import tokens as tk
from concordat.llm import truncation as tr
from concordat.runtime import cut_lineage, table


def p1_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").select(
        "response_id", "request_id", "question_id", "generated_at", "received_at", "channel", "confidence", "classification_confidence", "model_name"
    )
    return sv.trusted_calls(rows, table(spark, sf_dir, "ingest_channel"), table(spark, sf_dir, "model_price"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sv.best_representatives(
        p1_calls(spark, sf_dir),
        "call",
        sv.response_bundles(F.col("canonical_model").isNotNull()),
        sv.Trust("trust_order", "received_at", "response_id"),
    )
    return best.where("n_rows > 1").select(
        F.col("first_id").alias("first_response_id"), F.explode("kept").alias("field_name", "kept_response_id")
    )


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per call: dependent fields move in bundles; both confidences must come by one channel, which may scale them
    in its own way, and the usage by the channel of the model's name."""
    rows = table(spark, sf_dir, "response").select(
        "response_id", "request_id", "question_id", "generated_at", "received_at", "channel", "confidence", "classification_confidence",
        "model_name", "content_type", "media_type", "weight_strategy", "difficulty_score", "input_tokens", "output_tokens", "cost",
    )
    calls = sv.trusted_calls(rows, table(spark, sf_dir, "ingest_channel"), table(spark, sf_dir, "model_price"))
    bundles = [
        *sv.response_bundles(F.col("canonical_model").isNotNull()),
        sv.Bundle("labels", ("content_type", "media_type", "weight_strategy", "difficulty_score"), F.col("content_type").isNotNull()),
        sv.Bundle("usage", ("input_tokens", "output_tokens", "cost"), F.col("cost").isNotNull() & F.col("input_tokens").isNotNull()),
    ]
    calls = cut_lineage(calls)
    best = sv.best_representatives(
        calls, "call", bundles, sv.Trust("trust_order", "received_at", "response_id"),
        [sv.Dependency("confidence", "channel", "classification_confidence", "channel"), sv.Dependency("model_name", "channel", "usage", "channel")],
    )
    picks = best.select("call", "n_rows", F.col("first_id").alias("first_response_id"), F.explode_outer("kept").alias("bundle", "response_id"))
    fields = {"confidence": ["confidence"], "classification_confidence": ["classification_confidence"], "model_name": ["canonical_model"],
              "labels": ["content_type", "media_type", "weight_strategy", "difficulty_score"], "usage": ["input_tokens", "output_tokens", "cost"]}
    taken = picks.join(calls.drop("call"), "response_id", "left")
    out = [F.max(F.when(F.col("bundle") == b, F.col(c))).alias("model_name" if c == "canonical_model" else c) for b, cs in fields.items() for c in cs]
    return taken.groupBy("first_response_id", "n_rows").agg(*out)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").select("response_id", "channel", "reasoning", "step_by_step")
    return tr.truncated_texts(rows).select("response_id", "field_name", "pos")


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.truncation_by_source(table(spark, sf_dir, "response").select("response_id", "channel", "reasoning", "step_by_step"))


AID_COLUMNS = ("common_mistakes", "mnemonics_memory_aids", "flashcards")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    aids = table(spark, sf_dir, "learning_aid").select("aid_id", *AID_COLUMNS)
    return cp.copy_groups(aids, AID_COLUMNS, "aid_id").where("id <> first_id").select(F.col("first_id").alias("first_aid_id"), F.col("id").alias("aid_id"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group of copies with its number of copies."""
    aids = table(spark, sf_dir, "learning_aid").select("aid_id", *AID_COLUMNS)
    sizes = cp.collapsed(aids, AID_COLUMNS, "aid_id")
    return aids.join(sizes, aids["aid_id"] == sizes["first_id"]).select("aid_id", "n_copies", *AID_COLUMNS)


def _p4(spark: SparkSession, sf_dir: str):
    strategies = sorted(r[0] for r in table(spark, sf_dir, "strategy_weight").where("strategy is not null").select("strategy").distinct().collect())
    fields = {"content_type": an.CONTENT_TYPES, "weight_strategy": strategies, "difficulty_score": an.DIFFICULTIES}
    schema = an.label_schema(spark, fields)
    raw = table(spark, sf_dir, "label_vote").select("question_id", "model_name", *fields)
    votes = an.usable_votes(raw, schema, table(spark, sf_dir, "model_price"))
    items, annotators = an.fit_communities(votes, {f: len(labels) for f, labels in fields.items()})
    return schema, items, annotators


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, items, _ = _p4(spark, sf_dir)
    return an.consensus(items, schema).select("question_id", "field_name", "label")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, items, _ = _p4(spark, sf_dir)
    return an.consensus(items, schema, min_annotators=1)


def p4_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir)[2]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_ids(table(spark, sf_dir, "documents"))


def _p8(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "mix_target")
    sized = cut_lineage(tk.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return sized, targets, mx.draw_mixture(sized, targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)[2]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets, mixture = _p8(spark, sf_dir)
    return mx.mixture_report(mixture, sized, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.residue(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left once those with residue are out."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(rs.residue(documents.select("doc_id", "text")), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


_ALL = (
    p1_found, p1_records, p2_found, p2_sources, p3_found, p3_records, p4_found, p4_agreement, p4_annotators,
    p7_ids, p8_mixture, p8_shares, p9_found, p9_kept,
)
QUERIES = {f.__name__: f for f in _ALL}

_LABELS = "l0 as (select id, id as l from r)"
for _k in range(4):
    _LABELS += f""",
a{_k} as (select r.id, r.rid, r.q, r.g, least(l, case when rid is null then l else min(l) over (partition by rid) end) as l from r join l{_k} using (id)),
l{_k + 1} as (select id, least(l, case when q is null then l else min(l) over (partition by q, g) end) as l from a{_k})"""

SQL: dict[str, str] = {
    "p1_found": f"""with r as (select response_id as id, nullif(trim(lower(request_id)), '') as rid, question_id as q, generated_at as g from response), {_LABELS},
c as (select x.*, l, count(*) over (partition by l) as n, min(x.response_id) over (partition by l) as first_id, coalesce(t.trust_order, 1000) as trust,
  regexp_replace(lower(model_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') in (select regexp_replace(lower(model_name), '[^\\p{{L}}\\p{{N}}]', '', 'g') from model_price) as known
  from response x join l4 on x.response_id = l4.id left join ingest_channel t on x.channel = t.channel),
u as (select l, first_id, 'confidence' as field_name, response_id, trust, received_at from c where n > 1 and confidence between 0 and 1
  union all select l, first_id, 'classification_confidence', response_id, trust, received_at from c where n > 1 and classification_confidence between 0 and 1
  union all select l, first_id, 'model_name', response_id, trust, received_at from c where n > 1 and known)
select first_id as first_response_id, field_name, response_id as kept_response_id from
  (select *, row_number() over (partition by l, field_name order by trust, received_at desc nulls last, response_id) as k from u) where k = 1""",
}
