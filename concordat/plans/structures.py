"""Graph, validation, JSON, filter, join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import casts
from concordat.operators import graph as gr
from concordat.operators import validation as va
from concordat.operators.shredding import child_tables
from concordat.plans.base import Registry
from concordat.provider import ask, fan_out
from concordat.runtime import table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL

_EDGES = """with e as (select 'c' || o_custkey as source, 'PLACED' as edge_type, 'o' || o_orderkey as target from orders
union all select 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey from customer
union all select 'n' || n_nationkey, 'PART_OF', 'r' || n_regionkey from nation)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and their nations, and the nations' regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    parts = (
        (orders, name("c", "o_custkey"), "PLACED", name("o", "o_orderkey"), "customer", "order"),
        (customers, name("c", "c_custkey"), "LIVES_IN", name("n", "c_nationkey"), "customer", "nation"),
        (table(spark, sf_dir, "nation"), name("n", "n_nationkey"), "PART_OF", name("r", "n_regionkey"), "nation", "region"),
    )
    edges = [gr.edge_projection(*p) for p in parts]
    return edges[0].unionByName(edges[1]).unionByName(edges[2])


@_R.query(_EDGES + """select node, sum(o) as out_degree, sum(i) as in_degree, sum(o) + sum(i) as degree from (select source as node, 1 as o, 0 as i from e union all select target, 0, 1 from e) group by node""")
def grf_08_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(_edges(spark, sf_dir))


# orders hang on their customer, customers on their nation, nations on their region: three steps reach all
_COMPONENTS = _EDGES + """, up as (select target as node, source as parent from e where edge_type = 'PLACED' union all select source, target from e where edge_type <> 'PLACED'),
roots as (select u.node, coalesce(w.parent, v.parent, u.parent) as root from up u left join up v on u.parent = v.node left join up w on v.parent = w.node),
allnodes as (select node, root from roots union select root, root from roots)
"""


@_R.query(_COMPONENTS + """select node, min(node) over (partition by root) as component from allnodes""")
def grf_09_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.components(_edges(spark, sf_dir))


@_R.query(_COMPONENTS + """, s as (select root, count(*) as size from allnodes group by 1), t as (select sum(size) as n, count(*) as components, max(size) as largest, count(*) filter (size = 1) as isolated from s)
select n as nodes, (select count(*) from e) as edges, round((select count(*) from e) / (n * (n - 1)), 12) as density, components, largest, isolated from t""")
def grf_11_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.statistics(_edges(spark, sf_dir)).withColumn("density", F.round("density", 12))


@_R.query(_EDGES + """, b as (select distinct source, target from e union select target, source from e), h1 as (select distinct target as node from b where source = 'r0' and target <> 'r0'),
h2 as (select distinct b.target as node from b join h1 on b.source = h1.node where b.target not in (select node from h1) and b.target <> 'r0')
select 'r0' as node, 0 as hop union all select node, 1 from h1 union all select node, 2 from h2""")
def grf_10_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return gr.neighbourhood(edges, gr.nodes_of(edges).where("node = 'r0'"))


@_R.query(_EDGES + "select edge_type, count(*) as n from e group by 1")
def grf_12_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.type_histogram(_edges(spark, sf_dir))


@_R.query()
def grf_13_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.page_rank(_edges(spark, sf_dir))


@_R.query()
def grf_01_annotation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "response")
    return gr.annotation_graph(child_tables(responses, "response_id", "response_json", with_values=True), responses)


_TIER0 = "case when json_valid(response_json) then json_extract(response_json, '$.tier_0_classification.{0}') end"


@_R.query("""select response_id, case when content_type in ('conceptual_theory', 'conceptual_application', 'mathematical_derivation', 'numerical_calculation') then content_type else 'conceptual_theory' end as content_type,
case when media_type in ('text_only', 'image_based') then media_type else 'text_only' end as media_type, case when difficulty_score between 1 and 10 then difficulty_score else 5 end as difficulty_score,
case when classification_confidence between 0 and 1 then classification_confidence else 0.5 end as classification_confidence from response""")
def prj_06_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.repaired_classification(table(spark, sf_dir, "response"))
    return rows.select("response_id", "content_type", "media_type", "difficulty_score", "classification_confidence")


@_R.query("""select question_id, (coalesce(trim(question_id), '') = '')::int + (year is null)::int + (coalesce(trim(question_text), '') = '')::int + (not coalesce(marks > 0, false))::int as n_errors,
(not coalesce(year between 2000 and 2030, false))::int + (coalesce(trim(answer_key), '') = '')::int + coalesce(question_type <> 'NAT' and options is null, false)::int as n_warnings from question""")
def flt_02_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.question_issues(table(spark, sf_dir, "question"))
    return rows.select("question_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@_R.query("""select event_id, cast(json_extract(props, '$.k') as int) as k from events""")
def prj_17_json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(casts.tolerant_json(F.col("props")), "$.k", "int").alias("k"))


@_R.query("""select response_id from response where channel = 'direct_api' and difficulty_score between 3 and 7 and content_type like 'conceptual%'""")
def flt_03_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("channel = 'direct_api' and difficulty_score between 3 and 7")
    return rows.where(F.col("content_type").startswith("conceptual")).select("response_id")


@_R.query("""select o_orderkey from orders order by o_orderdate, o_orderkey limit 50 offset 100""")
def srt_11_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").offset(100).limit(50).select("o_orderkey")


@_R.query("""select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def jon_10_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@_R.query("""select question_id from question where question_id in (select question_id from response) and question_id in (select question_id from label_vote)""")
def jon_11_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: table(spark, sf_dir, t).select("question_id")
    return ids("question").join(ids("response"), "question_id", "left_semi").join(ids("label_vote"), "question_id", "left_semi")


@_R.query("""select question_id, list_sort(list(distinct model_name)) as models from response where question_id is not null and model_name is not null group by 1""")
def jon_18_aligned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("question_id is not null and model_name is not null")
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_set("model_name")).alias("models"))


@_R.query("""select question_id from response where question_id is not null union select question_id from documents where question_id is not null""")
def set_02_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: table(spark, sf_dir, t).where("question_id is not null").select("question_id")
    return ids("response").union(ids("documents")).distinct()


@_R.query("""select question_id from question except select question_id from documents""")
def set_03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: table(spark, sf_dir, t).select("question_id")
    return ids("question").subtract(ids("documents"))


@_R.query("""select s.subject, count(*) as n, count(distinct d.question_id) as questions from documents d left join question s on d.question_id = s.question_id group by 1""")
def jon_16_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "question").select("question_id", "subject")
    docs = table(spark, sf_dir, "documents").select("question_id")
    return docs.join(questions, "question_id", "left").groupBy("subject").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions"))


@_R.query("""select regexp_extract(question_id, '_(\\d{4})_', 1)::int as year, count(*) as n from question group by 1""")
def src_24_year_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.regexp_extract("question_id", r"_(\d{4})_", 1).cast("int")
    return table(spark, sf_dir, "question").groupBy(year.alias("year")).agg(F.count("*").alias("n"))


@_R.query()
def udf_01_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question put to two models through the stand-in provider."""
    questions = table(spark, sf_dir, "question").where("question_id is not null and question_text is not null")
    return ask(fan_out(questions, ["boreal_r1", "ondine_7b"], "question_id", "question_text")).select("request_id", "model", "text", "input_tokens", "error")
