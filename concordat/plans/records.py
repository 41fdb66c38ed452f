"""Queries on nested records (p5) and drifting files (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import drift, shredding
from concordat.runtime import cut_lineage, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.child_tables(table(spark, sf_dir, "response"), "response_id", "response_json")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of steps, mistakes and formulas: a row per leaf of each element, places counted from the levels."""
    levels = shredding.level_columns(table(spark, sf_dir, "response"), "response_id", "response_json")
    rows = shredding.ancestor_table(levels, "response_id", r"^(?:.*\.)?(?:step_by_step|common_mistakes|formulas_principles)\[\]")
    return rows.withColumn("child", F.regexp_extract("ancestor", r"(\w+)\[\]$", 1))


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.level_columns(table(spark, sf_dir, "response"), "response_id", "response_json")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(drift.ingest(table(spark, sf_dir, "raw_record")))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readable lines in the target schema, approved names and other kinds replayed, the rest as JSON."""
    ingested = cut_lineage(drift.ingest(table(spark, sf_dir, "raw_record")))
    rows = drift.promote(ingested, drift.approved_names(drift.drift_report(ingested)))
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], F.to_json("_rescued").alias("rescued"))


QUERIES = {f.__name__: f for f in (p5_found, p5_tables, p5_levels, p6_found, p6_table)}

SQL: dict[str, str] = {}
