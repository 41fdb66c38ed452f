"""Queries around annotation records: field consensus, metrics, references, judge replies, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import annotations as ao
from concordat.operators import records as rc
from concordat.plans.base import Registry
from concordat.runtime import table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL

_IS_CORRECT = "tier_1_core_research.answer_validation.is_correct"
_NUMBERS = ("difficulty_score", "tokens_used", "input_tokens", "output_tokens", "cost", "time_seconds")
_IDENTITIES = ("content_type", "media_type", "weight_strategy")


def _means() -> str:
    return ", ".join(f"round(sum({n} * w) filter ({n} is not null) / nullif(sum(w) filter ({n} is not null), 0), 6) as {n}" for n in _NUMBERS)


def _majorities() -> str:
    return ", ".join(
        f"(select v from (select {i} as v, count(*) as n from r x where x.question_id is not distinct from g.question_id and {i} is not null group by 1 order by n desc, v limit 1)) as {i}"
        for i in _IDENTITIES
    )


def _disputed() -> str:
    return " + ".join(
        f"coalesce((select (2 * max(n) <= sum(n))::int from (select count(*) as n from r x where x.question_id is not distinct from g.question_id and {i} is not null group by {i})), 0)" for i in _IDENTITIES
    )


@_R.query(f"""with r as (select *, case when model_name = 'boreal_r1' then 0.4 else 0.1 end as w,
  case when json_valid(response_json) then json_extract_string(response_json, '$.{_IS_CORRECT}') end as ok from response where question_id is not null),
g as (select question_id, coalesce(bool_or(ok = 'false'), false) as red_line, {_means()} from r group by 1)
select g.*, {_majorities()}, ({_disputed()})::bigint as n_disputed from g""")
def agg_07_field_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("question_id is not null")
    flag = F.when(F.try_parse_json("response_json").isNotNull(), F.get_json_object("response_json", f"$.{_IS_CORRECT}")).try_cast("boolean")
    weight = F.when(F.col("model_name") == "boreal_r1", 0.4).otherwise(0.1)
    out = ao.field_consensus(rows, ["question_id"], flag, list(_IDENTITIES), list(_NUMBERS), weight)
    return out.select("question_id", "red_line", *[F.round(n, 6).alias(n) for n in _NUMBERS], *_IDENTITIES, "n_disputed")


@_R.query()
def agg_22_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and filled fields of every readable record, whatever it is wrapped in."""
    return ao.completeness(rc.flattened(table(spark, sf_dir, "response"), "response_id", "response_json"), "response_id")


def _metrics_sql() -> str:
    name = lambda p: p.rsplit(".", 1)[-1]
    count = lambda p: f"case when json_type(j, '$.{p}') = 'ARRAY' then len(list_filter(json_extract(j, '$.{p}[*]'), lambda x: json_type(x) <> 'NULL')) else 0 end"
    length = " + ".join(f"case when json_type(j, '$.{p}') = 'VARCHAR' then length(json_extract_string(j, '$.{p}')) else 0 end" for p in ao.TEXTS)
    numbers = ", ".join(f"case when json_type(j, '$.{p}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then json_extract_string(j, '$.{p}')::double end as {name(p)}" for p in ao.NUMBERS)
    counts = ", ".join(f"({count(p)})::int as {name(p)}" for p in ao.LISTS)
    total = " + ".join(name(p) for p in ao.LISTS)
    inner = f"select response_id, {counts}, ({length})::int as text_length, {numbers} from (select response_id, response_json::json as j from response where json_valid(response_json))"
    return f"select *, ({total})::int as n_items, (formulas_principles + formulas_used)::int as n_formulas from ({inner})"


@_R.query(_metrics_sql())
def agg_23_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ao.record_metrics(table(spark, sf_dir, "response"), "response_id", "response_json")


@_R.query("""with s as (select question_id, channel, sum(time_seconds) as s from response group by 1, 2),
st as (select question_id, round(sum(s), 5) as seconds, (list(channel order by round(s, 6) desc, channel nulls first) filter (s is not null))[1] as slowest from s group by 1),
m as (select question_id, model_name, coalesce(sum(tokens_used), 0)::bigint as t from response where model_name is not null group by 1, 2),
mt as (select question_id, count(*) as n_models, sum(t)::bigint as tokens, string_agg(model_name || '=' || t, '|' order by model_name) as by_model from m group by 1)
select st.*, n_models, tokens, by_model from st left join mt on st.question_id = mt.question_id where st.question_id is not null""")
def agg_15_run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("question_id is not null")
    return ao.run_metadata(rows, ["question_id"], "model_name", "channel", "time_seconds", "tokens_used").withColumn("seconds", F.round("seconds", 5))


@_R.query("""select source, count(*) as entries, coalesce(sum(length(text)), 0)::bigint as characters, min(loaded_at) as oldest, max(loaded_at) as newest from documents group by 1""")
def agg_39_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ao.storage_statistics(table(spark, sf_dir, "documents"), ["source"], "text", "loaded_at")


@_R.query("""with e as (select distinct year, question_id from question), d as (select distinct question_id from response where question_id is not null)
select year, count(*) as total, count(d.question_id) as done, count(*) - count(d.question_id) as remaining, round(count(d.question_id) / count(*), 6) as done_share from e left join d on e.question_id = d.question_id group by 1""")
def agg_45_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ao.resume_info(table(spark, sf_dir, "question"), table(spark, sf_dir, "response"), ["question_id"], "year")
    return out.withColumn("done_share", F.round("done_share", 6))


@_R.query("""select event_id, round((count(*) over (partition by event_type) - row_number() over (partition by event_type order by ts, event_id)) *
avg(value) over (partition by event_type order by ts, event_id rows between 99 preceding and current row), 4) as eta from events""")
def win_07_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ao.remaining_time(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_id", F.round("eta", 4).alias("eta"))


@_R.query("""select channel, response_id from (select *, row_number() over (partition by channel order by md5('7:' || response_id), response_id) as r from response) where r <= 5""")
def flt_13_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ao.seeded_sample(table(spark, sf_dir, "response"), "channel", "response_id", 5, 7).select("channel", "response_id")


@_R.query("""select o_custkey, o_orderkey from (select *, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as s from orders) where round(s, 6) <= 500000""")
def flt_15_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ao.affordable(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500000.0).select("o_custkey", "o_orderkey")


@_R.query("""select r.response_id from response r where trim(r.model_name) <> '' and not exists (select 1 from label_vote v where v.question_id = r.question_id and v.model_name = r.model_name)""")
def flt_14_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named answers whose model has not labelled their question."""
    rows = table(spark, sf_dir, "response").where("trim(model_name) <> ''")
    return rows.join(table(spark, sf_dir, "label_vote").select("question_id", "model_name"), ["question_id", "model_name"], "left_anti").select("response_id")


@_R.query("""select question_id from question where has_question_image and question_id in (select question_id from response where trim(reasoning) <> '' group by 1 having count(*) >= 2)""")
def flt_12_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an image that at least two non-blank texts describe."""
    enough = table(spark, sf_dir, "response").where("trim(reasoning) <> ''").groupBy("question_id").count().where("count >= 2")
    return table(spark, sf_dir, "question").where("has_question_image").join(enough, "question_id", "left_semi").select("question_id")


@_R.query("""select doc_id, case when trim(coalesce(text, '')) = '' then '[EMPTY/MISSING]' when length(text) > 60 then left(text, 60) || '...' else text end as shown from documents""")
def prj_22_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ao.shown(F.col("text")).alias("shown"))


@_R.query("""select doc_id, case when source = 'book_note' then 'Book' when source = 'video_note' then 'Video' else 'Text' end || ': ' ||
concat_ws(', ', chunk_id, nullif(trim(subject), ''), nullif(trim(lang), ''), nullif(trim(question_id), '')) as reference from documents""")
def prj_11_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source") == "book_note", "Book").when(F.col("source") == "video_note", "Video").otherwise("Text")
    return table(spark, sf_dir, "documents").select("doc_id", ao.reference(kind, F.col("chunk_id"), F.col("subject"), F.col("lang"), F.col("question_id")).alias("reference"))


@_R.query("""with c as (select q.*, r.response_id, r.content_type, r.media_type, r.difficulty_score from response r left join question q on r.question_id = q.question_id)
select response_id, coalesce(exam_name, '') as exam_name, coalesce(content_type, 'conceptual_theory') as content_type, coalesce(media_type, case when has_question_image then 'image_based' else 'text_only' end) as media_type,
coalesce(difficulty_score, 5) as difficulty_score from c""")
def prj_08_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the root fields of their question and a classification filled by its fallback."""
    q = table(spark, sf_dir, "question").select("question_id", "exam_name", "has_question_image")
    rows = table(spark, sf_dir, "response").select("response_id", "question_id", "content_type", "media_type", "difficulty_score").join(q, "question_id", "left")
    media = F.coalesce("media_type", F.when(F.col("has_question_image"), "image_based").otherwise("text_only"))
    return rows.select(
        "response_id", F.coalesce("exam_name", F.lit("")).alias("exam_name"), F.coalesce("content_type", F.lit("conceptual_theory")).alias("content_type"),
        media.alias("media_type"), F.coalesce("difficulty_score", F.lit(5)).alias("difficulty_score"),
    )


_PATHS = """with r as (select response_id, response_json::json as j from response where json_valid(response_json)),
t as (select response_id, unnest(json_keys(j)) as k, j from r where json_type(j) = 'OBJECT')
"""


@_R.query(_PATHS + """select distinct replace(k, '.', '_') as field_key from t""")
def srt_07_field_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct top-level fields of all records as keys, sorted."""
    v = F.try_parse_json("response_json")
    keys = table(spark, sf_dir, "response").where(F.schema_of_variant(v).startswith("OBJECT")).select(F.explode(F.map_keys(v.try_cast("map<string,variant>"))).alias("k"))
    return keys.select(ao.field_key(F.col("k")).alias("field_key")).distinct().orderBy("field_key")


@_R.query("""select response_id, coalesce(case when json_valid(reply) then json_extract_string(reply, '$.winner') end, nullif(regexp_extract(reply, 'winner[^a-zA-Z0-9_]{1,8}([a-zA-Z0-9_]+)', 1), '')) as winner from
(select response_id, case response_id % 4 when 0 then '{"winner": "' || channel || '"}' when 1 then 'I think {"winner": "' || channel || '"} is right' when 2 then 'winner: ' || channel when 3 then 'no verdict' end as reply from response)""")
def scl_25_judge_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of several shapes, made from the channel that each answer came through."""
    said = F.concat(F.lit('{"winner": "'), F.col("channel"), F.lit('"}'))
    shape = F.col("response_id") % 4
    reply = F.when(shape == 0, said).when(shape == 1, F.concat(F.lit("I think "), said, F.lit(" is right"))).when(shape == 2, F.concat(F.lit("winner: "), F.col("channel"))).otherwise("no verdict")
    return table(spark, sf_dir, "response").select("response_id", ao.judge_reply(reply).alias("winner"))


_DECLARED = ("topic", "year")


@_R.query("""with n as (select doc_id, text, list_sort(list_distinct(regexp_extract_all(text, '\\{([A-Za-z_]+)\\}', 1))) as names from documents where text is not null)
select doc_id, array_to_string(list_filter(names, lambda x: x not in ('topic', 'year')), '|') as undeclared, array_to_string(list_filter(['topic', 'year'], lambda x: not list_contains(names, x)), '|') as unused,
length(replace(text, '{', '')) = length(replace(text, '}', '')) as balanced from n""")
def val_07_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text read as a template with the variables topic and year."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.array(ao.template_problems(F.col("text"), list(_DECLARED)))).alias("t"))
    return rows.select("doc_id", F.array_join("t.undeclared", "|").alias("undeclared"), F.array_join("t.unused", "|").alias("unused"), "t.balanced")


@_R.query("""select response_id, json_valid(response_json) as is_json, length(trim(coalesce(reasoning, ''))) > 0 as is_text from response where response_json is not null""")
def val_06_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "response").where("response_json is not null").select(
        "response_id", F.try_parse_json("response_json").isNotNull().alias("is_json"), (F.length(F.trim(F.coalesce("reasoning", F.lit("")))) > 0).alias("is_text")
    )


@_R.query("""with e as (select 'c' || o_custkey as a, 'o' || o_orderkey as b, 'PLACED' as edge_type from orders union all select 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' from customer),
s as (select 'n' || n_nationkey as node from nation where n_regionkey = 0), x as (select b as node, edge_type from e where a in (select node from s) union select a, edge_type from e where b in (select node from s))
select node, edge_type from x where node not in (select node from s)""")
def jon_12_new_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whoever an edge ties to the nations of the first region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"), F.lit("PLACED").alias("edge_type"))
    customers = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("LIVES_IN").alias("edge_type"))
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(name("n", "n_nationkey").alias("node"))
    return ao.new_neighbours(orders.unionByName(customers), nations)


@_R.query("""select n.n_nationkey, r.r_name as parent, c.customers from nation n left join region r on n.n_regionkey = r.r_regionkey left join (select c_nationkey, count(*) as customers from customer group by 1) c on c.c_nationkey = n.n_nationkey""")
def jon_14_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, sf_dir, "nation").join(regions, "n_regionkey", "left").join(customers, "n_nationkey", "left").select("n_nationkey", "parent", "customers")


@_R.query("""select q.question_id, d.doc_id from question q join documents d on regexp_extract(q.question_id, '([0-9]{4})_[A-Z]+_Q([0-9]+)$', 0) = regexp_extract(d.question_id, '([0-9]{4})_[A-Z]+_Q([0-9]+)$', 0)
and regexp_extract(q.question_id, '([0-9]{4})_[A-Z]+_Q([0-9]+)$', 0) <> '' where q.has_question_image""")
def jon_09_by_parts_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of questions with an image, by the year, subject and number within their ids."""
    key = lambda c: F.regexp_extract(c, r"([0-9]{4})_[A-Z]+_Q([0-9]+)$", 0)
    q = table(spark, sf_dir, "question").where("has_question_image").select("question_id", key("question_id").alias("k")).where("k <> ''")
    return q.join(table(spark, sf_dir, "documents").select("doc_id", key("question_id").alias("k")), "k").select("question_id", "doc_id")


@_R.query("""select question_id, md5(coalesce(question_text, '')) as digest, to_base64(encode(coalesce(question_text, ''))) as encoded, strftime(updated_at::timestamp, '%Y%m%d_%H%M%S') as stamp from question""")
def scl_31_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("question_text", F.lit(""))
    stamp = F.date_format("updated_at", "yyyyMMdd_HHmmss")
    return table(spark, sf_dir, "question").select("question_id", F.md5(text).alias("digest"), F.translate(F.base64(text.cast("binary")), "\r\n", "").alias("encoded"), stamp.alias("stamp"))
