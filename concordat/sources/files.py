"""Readers of question files, response trees, corpora, sheets, graphs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.casts import tolerant_json


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, index, body)``: one row per question; an array file gives its elements with a question_id, any other file itself.

    ``body`` is JSON text. A file that cannot be read gives one row with a null body.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = raw.withColumn("v", tolerant_json(F.col("value")))
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("transform(cast(v as array<variant>), x -> to_json(x))")).otherwise(F.array(F.to_json("v")))
    each = parsed.select("file", F.posexplode_outer(items).alias("index", "body"), F.schema_of_variant("v").startswith("ARRAY").alias("listed"))
    return each.where(~F.coalesce("listed", F.lit(False)) | F.get_json_object("body", "$.question_id").isNotNull()).select("file", "index", "body")


def response_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(year, question_id, model, body)`` of files under ``year/question/model/``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    parts = F.split(F.input_file_name(), "/")
    return raw.select(
        F.element_at(parts, -4).try_cast("int").alias("year"), F.element_at(parts, -3).alias("question_id"), F.element_at(parts, -2).alias("model"), F.col("value").alias("body")
    )


def final_records(spark: SparkSession, root: str, pattern: str = "*_final_json.json") -> DataFrame:
    """``(question_id, body)``: the first file by name of each question."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    named = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("body"))
    qid = F.regexp_extract("file", r"^(.*?_Q\d+)", 1)
    return named.groupBy(qid.alias("question_id")).agg(F.min_by("body", "file").alias("body"))


def corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks of all JSON-array files; fields missing in one are null, no path gives no rows."""
    schema = "chunk_id string, text string, metadata map<string, string>"
    out = spark.createDataFrame([], schema)
    for path in paths:
        out = out.unionByName(spark.read.schema(schema).option("multiLine", "true").json(path), allowMissingColumns=True)
    return out


def text_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.option("header", "true").option("multiLine", "true").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def graph_files(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of CSV files whose id column may be named id, node_id or ID."""
    n = spark.read.option("header", "true").csv(nodes)
    ids = [F.col(c) for c in ("node_id", "id", "ID") if c in n.columns]
    return n.withColumn("node_id", F.coalesce(*ids)), spark.read.option("header", "true").csv(edges)


def log_lines(spark: SparkSession, path: str, *marks: str) -> DataFrame:
    """``(file, line)`` of log lines that hold any of the marks, in any case."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    hit = F.lit(not marks)
    for m in marks:
        hit = hit | F.contains(F.lower("line"), F.lit(m.lower()))
    return lines.where(hit)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """``(year, number, path, size, content)`` of question images named by their number."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").rlike(r"\.(png|jpe?g)$"))
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(
        F.element_at(F.split("path", "/"), -2).try_cast("int").alias("year"),
        F.regexp_extract(name, r"(?i)Q(\d+)(?!\d)", 1).try_cast("int").alias("number"), "path", F.col("length").alias("size"), "content",
    )


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of each record in a versioned store written by ``sinks.write_versioned``."""
    rows = spark.read.parquet(root)
    return rows.groupBy("question_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "question_id"]), "version").alias("r")).select("question_id", "r.*")
