"""Queries on the typed records: their graph, completeness, merged fields, and the whole path of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import consensus as cs
from concordat.operators import graph as gr
from concordat.operators import pipeline as pl
from concordat.operators import silver as sv
from concordat.plans.base import Registry
from concordat.runtime import cut_lineage, table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.silver(table(spark, sf_dir, "response").select("response_id", "question_id", "response_json"), "response_json")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(sv.knowledge_edges(_typed(spark, sf_dir)))


@_R.query()
def grf_02_knowledge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.knowledge_edges(_typed(spark, sf_dir))


@_R.query()
def grf_07_knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.knowledge_nodes(_graph(spark, sf_dir))


@_R.query()
def agg_44_knowledge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.statistics(_graph(spark, sf_dir))


@_R.query()
def srt_06_top_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(_graph(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(20)


@_R.query("""select question_id, model_name from (select *, row_number() over (partition by question_id order by n desc, o) as r from
(select question_id, model_name, count(*) as n, min(response_id) as o from response where trim(model_name) not in ('', 'null', '{}', '[]', '""') group by all)) where r = 1""")
def agg_11_merged_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.merged_value(table(spark, sf_dir, "response"), ["question_id"], "model_name", "response_id")


@_R.query("""select question_id, count(distinct model_name) as models from response group by 1 having count(distinct model_name) >= 2""")
def flt_08_enough_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.answered_by_enough(table(spark, sf_dir, "response"), "question_id", "model_name")


@_R.query("""with e as (select distinct question_id, content_type from label_vote where content_type is not null and question_id is not null)
select e.question_id, e.content_type from e where not exists (select 1 from response r where r.question_id = e.question_id and r.content_type = e.content_type)""")
def flt_10_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that annotators give and no response has."""
    votes = table(spark, sf_dir, "label_vote").where("content_type is not null and question_id is not null")
    return cs.missing_paths(votes, table(spark, sf_dir, "response"), ["question_id"], "content_type")


@_R.query("""select model_name, round(sum(cost), 6) as spent, case when sum(cost) >= 0.2 then 'EXCEEDED' when sum(cost) >= 0.18 then 'CRITICAL' when sum(cost) >= 0.15 then 'WARNING' else 'OK' end as status from response group by 1""")
def agg_19_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "response").groupBy("model_name").agg(F.sum("cost").alias("spent"))
    return spent.select("model_name", F.round("spent", 6).alias("spent"), cs.budget_status(F.col("spent"), 0.2).alias("status"))


@_R.query("""select count(*) as processed, count(*) filter (classification_method is null) as failed, count(*) filter (tokens_used > 10000) as hits, round(count(*) filter (tokens_used > 10000) / count(*), 6) as hit_rate from response""")
def agg_20_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response")
    out = pl.progress(rows, F.when(F.col("classification_method").isNull(), "failed").otherwise("done"), F.coalesce(F.col("tokens_used") > 10000, F.lit(False)))
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@_R.query("""select question_id from question where question_id not in (select question_id from response where question_id is not null)""")
def str_06_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no response has answered yet."""
    done = table(spark, sf_dir, "response").where("question_id is not null")
    return pl.unprocessed(table(spark, sf_dir, "question"), done, "question_id").select("question_id")


@_R.query()
def pip_01_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question through context, answers, vote and second round, with the stand-in provider."""
    questions = table(spark, sf_dir, "question").where("question_id is not null").select("question_id", "question_text")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pl.answer_questions(questions, documents, {"boreal_r1": 0.4, "ondine_7b": 0.35, "sable_base": 0.25}, "cobalt_think")
