"""Round trips through the writers and readers: what is read back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.plans.base import Registry
from concordat.runtime import shared_folder, table
from concordat.sources import files, sinks

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


@_R.query("select response_id, question_id, cost from response where question_id is not null")
def snk_02_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON in a folder per channel."""
    path = shared_folder(spark, "json")
    sinks.write_json(table(spark, sf_dir, "response").where("question_id is not null").select("response_id", "question_id", "cost", "channel"), path, ["channel"], "gzip")
    return spark.read.schema("response_id long, question_id string, cost double").json(path).select("response_id", "question_id", "cost")


@_R.query("select question_id, case when year % 2 = 0 then 'b' else 'a' end as version, marks + case when year % 2 = 0 then 1 else 0 end as marks from question")
def snk_03_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the questions, the second of even years only, and the newest of each by its pointer."""
    path, rows = shared_folder(spark, "versions"), table(spark, sf_dir, "question").select("question_id", "year", "marks")
    sinks.write_latest(rows, path, "a", "question_id")
    sinks.write_latest(rows.where("year % 2 = 0").withColumn("marks", F.col("marks") + 1), path, "b", "question_id")
    stored = spark.read.schema("question_id string, year int, marks double, version string").json(f"{path}/versions")
    return stored.join(spark.read.parquet(f"{path}/latest"), ["question_id", "version"]).select("question_id", "version", "marks")


@_R.query("select question_id, year from question where year >= 2015")
def snk_04_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries still alive: those of later years; the others expire at once."""
    path, rows = shared_folder(spark, "cache"), table(spark, sf_dir, "question").select("question_id", "year")
    sinks.write_cache(rows.where("year >= 2015"), path, 86_400)
    sinks.write_cache(rows.where("year < 2015"), path, 0)
    return sinks.live_cache(spark.read.parquet(path)).select("question_id", "year")


_META = {"content_type": "tier_0_classification.content_type", "answer": "tier_1_core_research.answer_validation.correct_answer"}


@_R.query("select response_id, " + ", ".join(
    f"case when json_valid(response_json) and json_type(response_json, '$.{p}') not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string(response_json, '$.{p}') end as {n}" for n, p in _META.items()
) + " from response")
def snk_05_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "metadata")
    table(spark, sf_dir, "response").select("response_id", sinks.metadata_row(F.col("response_json"), _META).alias("m")).select("response_id", "m.*").write.parquet(path)
    return spark.read.parquet(path)


@_R.query("select question_id, year, marks, has_question_image, exam_name from question")
def snk_06_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as type-tagged rows and back."""
    path = shared_folder(spark, "tagged")
    rows = table(spark, sf_dir, "question").select("question_id", "year", "marks", "has_question_image", "exam_name")
    rows.select(sinks.tagged(rows).alias("value")).write.text(path)
    back = sinks.untagged(F.col("value"), "question_id string, year int, marks double, has_question_image boolean, exam_name string")
    return spark.read.text(path).select(back.alias("r")).select("r.*")


@_R.query("select 'c' || c_custkey as node_id, 'n' || c_nationkey as target from customer")
def snk_09_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as CSV, read back and joined."""
    path, c = shared_folder(spark, "graph"), table(spark, sf_dir, "customer")
    sinks.write_csv(c.select(F.concat(F.lit("c"), "c_custkey").alias("id")), f"{path}/nodes")
    sinks.write_csv(c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target")), f"{path}/edges")
    nodes, edges = files.graph_files(spark, f"{path}/nodes", f"{path}/edges")
    return nodes.select("node_id").join(edges, nodes["node_id"] == edges["source"]).select("node_id", "target")


@_R.query("""select doc_id::varchar as doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') as text from documents where regexp_matches(text, '\\S')""")
def snk_11_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several lines with quotes through a CSV sheet; a carriage return is read as a line break."""
    path = shared_folder(spark, "sheet")
    sinks.write_csv(table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", F.regexp_replace("text", "\\r\\n?", "\n").alias("text")), path)
    return spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').schema("doc_id string, text string").csv(path)


@_R.query("""select count(*) as n from (select unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as line from documents) where lower(line) like '%error%' or lower(line) like '%denied%'""")
def src_14_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a log; the lines that name an error or a denial."""
    path = shared_folder(spark, "log")
    table(spark, sf_dir, "documents").where("text is not null").select(F.regexp_replace("text", "\\r\\n?", "\n").alias("value")).write.text(path)
    return files.log_lines(spark, path, "error", "denied").agg(F.count("*").alias("n"))
