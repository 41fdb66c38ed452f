"""Declarative rules on nested records, compiled to Columns, and repair of what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.casts import safe_double
from concordat.operators import rules


def violations(records: DataFrame, row_id: str, text: str, shapes: dict[str, rules.Shape] = rules.RECORD_SHAPES) -> DataFrame:
    """``(row_id, section, check, path)``: one row per rule a record breaks.

    check is required (the field is not there), null (at the top of a section), type,
    enum, range, element (of a list, no object) or, for a text that is no JSON object,
    json. Structs and list elements are held to their own shapes, elements with their
    place in the path. A null further down is allowed; a section that is missing
    breaks one rule only. A null text gives no row, repeated rows are judged each.
    """
    parsed = records.where(F.col(text).isNotNull()).select(
        # exploded, so that every record is parsed once and not once per rule
        row_id, F.explode(F.array(F.try_parse_json(text))).alias("_v")
    )
    entry = lambda section, check, path: F.struct(F.lit(section).alias("section"), F.lit(check).alias("check"), F.lit(path).alias("path"))
    root = F.array(*[F.when(F.try_variant_get("_v", f"$.{f}", "variant").isNull(), entry("root", "required", f)) for f in rules.ROOT])
    frame, broken = rules.broken_rules(parsed, "_v", shapes)
    readable = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    errors = F.when(readable, F.concat(root, broken)).otherwise(F.array(entry("root", "json", "$")))
    each = frame.select(row_id, F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("e"))
    return each.select(row_id, "e.section", "e.check", "e.path")


def violation_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("section", "check").agg(F.count("*").alias("n"))


_ALLOWED = rules.RECORD_SHAPES["tier_0_classification"].allowed


def repaired_classification(rows: DataFrame) -> DataFrame:
    """Rows whose content_type, media_type, difficulty_score, weight_strategy and confidence are brought into their domains.

    An unknown label becomes the default of its field, a difficulty outside 1 to 10
    becomes 5, a confidence outside 0 to 1 becomes 0.5.
    """
    allowed = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(default))
    confidence = F.col("classification_confidence")
    return rows.withColumns(
        {
            "content_type": allowed("content_type", _ALLOWED["content_type"], "conceptual_theory"),
            "media_type": allowed("media_type", _ALLOWED["media_type"], "text_only"),
            "weight_strategy": allowed("weight_strategy", _ALLOWED["weight_strategy"], "BALANCED"),
            "difficulty_score": F.when(F.col("difficulty_score").between(1, 10), F.col("difficulty_score")).otherwise(F.lit(5)),
            "classification_confidence": F.when(confidence.between(0.0, 1.0) & ~F.isnan(confidence), confidence).otherwise(F.lit(0.5)),
        }
    )


def question_issues(questions: DataFrame) -> DataFrame:
    """Questions with ``errors`` and ``warnings``: missing id, year or text and marks of 0 or below are errors."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    errors = F.array(
        F.when(blank("question_id"), "missing id"), F.when(F.col("year").isNull(), "missing year"), F.when(blank("question_text"), "missing text"),
        F.when(~F.coalesce(F.col("marks") > 0, F.lit(False)), "marks not positive"),
    )
    warnings = F.array(
        F.when(~F.coalesce(F.col("year").between(2000, 2030), F.lit(False)), "odd year"), F.when(blank("answer_key"), "missing answer"),
        F.when((F.col("question_type") != "NAT") & F.col("options").isNull(), "missing options"),
    )
    there = lambda a: F.filter(a, lambda x: x.isNotNull())
    return questions.withColumn("errors", there(errors)).withColumn("warnings", there(warnings))


def auto_fixed_numbers(rows: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Rows whose text columns are read as numbers, defaults where that fails."""
    return rows.withColumns({c: safe_double(F.col(c), d) for c, d in columns.items()})
