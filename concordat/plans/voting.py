"""Consensus queries: the models' answers to one question voted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import consensus as cs
from concordat.operators import records as rc
from concordat.operators import similarity as sm
from concordat.operators.shredding import child_tables
from concordat.plans.base import Registry
from concordat.runtime import table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


@_R.query("""select question_id, round(sum(difficulty_score * confidence) / nullif(sum(confidence), 0), 6) as average from
(select * from response where difficulty_score is not null and confidence between 0 and 1) group by question_id""")
def agg_05_weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("difficulty_score is not null and confidence between 0 and 1 and not isnan(confidence)")
    return cs.weighted_average(rows, ["question_id"], "difficulty_score", "confidence").select("question_id", F.round("average", 6).alias("average"))


@_R.query("""select question_id, content_type, votes from (select *, row_number() over (partition by question_id order by votes desc, content_type) as r
from (select question_id, content_type, count(*) as votes from label_vote where content_type is not null group by all)) where r = 1""")
def agg_06_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.majority(table(spark, sf_dir, "label_vote"), ["question_id"], "content_type")


_WEIGHTED = """with v as (select question_id, weight_strategy as v, case when model_name = 'boreal_r1' then 0.4 else 0.1 end as w from label_vote),
s as (select question_id, v, sum(w) as w from v group by all),
t as (select question_id, sum(w) as total from s where v is not null group by 1),
b as (select * from (select *, row_number() over (partition by question_id order by round(w, 10) desc, v) as r from s where v is not null) where r = 1)
"""


@_R.query(_WEIGHTED + """select q.question_id, b.v as winner, case when round(b.w / t.total, 10) >= 0.7 then 'accepted' else 'disputed' end as status
from (select distinct question_id from v) q left join b on q.question_id is not distinct from b.question_id left join t on q.question_id is not distinct from t.question_id""")
def agg_09_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "label_vote").withColumn("w", F.when(F.col("model_name") == "boreal_r1", 0.4).otherwise(0.1))
    return cs.weighted_vote(votes, ["question_id"], "weight_strategy", "w").select("question_id", "winner", "status")


_MODELS = "select distinct question_id, weight_strategy, model_name from response where model_name is not null and weight_strategy is not null and question_id is not null"


@_R.query(f"""select question_id, weight_strategy, model_name, round(w / sum(w) over (partition by question_id, weight_strategy), 8) as weight from
(select m.*, coalesce(s.weight, 0.25) as w from ({_MODELS}) m left join strategy_weight s on m.weight_strategy = s.strategy and m.model_name = s.model_name)""")
def jon_07_strategy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "response").where("model_name is not null and weight_strategy is not null and question_id is not null").select("question_id", "weight_strategy", "model_name").distinct()
    out = cs.strategy_weights(models, table(spark, sf_dir, "strategy_weight"), ["question_id", "weight_strategy"], "weight_strategy", "model_name")
    return out.select("question_id", "weight_strategy", "model_name", F.round("weight", 8).alias("weight"))


@_R.query("""select strategy, model_name, round(0.7 * weight / sum(weight) over (partition by strategy), 8) as weight from strategy_weight
union all select distinct strategy, 'tiebreaker', 0.3 from strategy_weight""")
def agg_10_tiebreaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cs.with_tiebreaker(table(spark, sf_dir, "strategy_weight"), ["strategy"], "model_name", "weight", "tiebreaker")
    return out.select("strategy", "model_name", F.round("weight", 8).alias("weight"))


@_R.query("""select question_id, coalesce(bool_or(is_correct = 'false'), false) as red_line from
(select question_id, case when json_valid(response_json) then json_extract_string(response_json, '$.tier_1_core_research.answer_validation.is_correct') end as is_correct from response) group by question_id""")
def flt_04_red_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.try_parse_json("response_json").isNotNull(), F.get_json_object("response_json", "$.tier_1_core_research.answer_validation.is_correct")).try_cast("boolean")
    return cs.red_line(table(spark, sf_dir, "response").select("question_id", flag.alias("ok")), ["question_id"], "ok")


@_R.query("""select o_custkey, o_orderkey, cast(floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / greatest(1, floor(count(*) over (partition by o_custkey) / 8))) as int) as batch from orders""")
def srt_08_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@_R.query("""with x as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as p, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey, case when p < 20 then 'queued' else 'unprocessed' end as status,
cast(case when p >= 20 then null when n <= 3 then 0 when n <= 8 then case when p < n // 2 then 0 else 1 end when n <= 15 then floor(p / ((n + 2) // 3)) else floor(p / 5) end as int) as batch from x""")
def srt_09_dispute_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.dispute_batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@_R.query("""with q as (select question_id, avg(case when confidence between 0 and 1 then confidence end) as conf, count(distinct model_name) % 3 as rounds, count(*) as n from response group by 1),
s as (select question_id, 0.25 * coalesce(conf, 0.75) + 0.30 * 0.9 + 0.20 * case rounds when 0 then 1.0 when 1 then 0.9 else 0.7 end + 0.15 * 0.7 + 0.10 * least(n / 150.0, 1.0) as score from q)
select question_id, round(score, 6) as score, case when round(score, 6) >= 0.9 then 'GOLD' when round(score, 6) >= 0.8 then 'SILVER' when round(score, 6) >= 0.7 then 'BRONZE' else 'REVIEW' end as band from s""")
def agg_13_quality_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.when(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.col("confidence"))
    q = table(spark, sf_dir, "response").groupBy("question_id").agg(F.avg(usable).alias("conf"), (F.count_distinct("model_name") % 3).alias("rounds"), F.count("*").alias("n"))
    null = F.lit(None).cast("double")
    score = F.round(cs.quality_score(F.col("conf"), null, F.col("rounds"), null, F.col("n")), 6)
    return q.select("question_id", score.alias("score"), cs.quality_band(score).alias("band"))


@_R.query()
def agg_35_text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of every step that the models give for a question, by its place."""
    steps = table(spark, sf_dir, "response").where("question_id is not null").select("question_id", F.posexplode("step_by_step").alias("pos", "t"), F.lit(1.0).alias("w"))
    return sm.agreement(steps, ["question_id", "pos"], "t", "w")


@_R.query()
def agg_37_merged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("question_id is not null").select("question_id", F.col("reasoning").alias("t"), F.lit(1.0).alias("w"))
    return sm.merged_sentences(rows, ["question_id"], "t", "w")


@_R.query()
def jon_17_distinct_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of every answer without those that repeat an earlier one."""
    steps = table(spark, sf_dir, "response").select("response_id", F.posexplode("step_by_step").alias("pos", "t"))
    return sm.distinct_items(steps, ["response_id"], "pos", "t")


@_R.query()
def prj_19_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.flattened(table(spark, sf_dir, "response"), "response_id", "response_json")


@_R.query()
def agg_14_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response")
    return rc.field_counts(rc.flattened(rows, "response_id", "response_json"), "response_id", rows)


@_R.query()
def agg_23_element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-null elements of every list of every response."""
    return child_tables(table(spark, sf_dir, "response"), "response_id", "response_json").groupBy("response_id", "child").agg(F.count("*").alias("n"))


@_R.query("""select response_id, content_type || '_' || media_type as combined_type,
case when media_type like '%image%' and content_type like '%math%' then 'MATH_IMAGE_HYBRID' when media_type like '%image%' then 'VISION_WEIGHTED' when content_type like '%math%' then 'MATH_WEIGHTED'
when content_type like '%numerical%' then 'NUMERICAL_WEIGHTED' when content_type like '%application%' then 'APPLICATION_WEIGHTED' when content_type like '%conceptual%' then 'CONCEPTUAL_WEIGHTED' else 'BALANCED' end as strategy
from response where content_type is not null and media_type is not null""")
def prj_05_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("content_type is not null and media_type is not null")
    c, m = F.col("content_type"), F.col("media_type")
    return rows.select("response_id", rc.combined_type(c, m).alias("combined_type"), rc.weight_strategy(c, m).alias("strategy"))
