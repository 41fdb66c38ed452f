"""Typed annotation records out of JSON, and the graph of what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.functions.casts import tolerant_json

#: Typed layer of a record; unknown fields are dropped, values of another type are null.
RECORD = """tier_0_classification struct<content_type string, media_type string, weight_strategy string, difficulty_score int, classification_confidence double, classification_method string, classifier_model string>,
tier_1_core_research struct<
  answer_validation struct<correct_answer string, is_correct boolean, confidence double, confidence_type string, reasoning string>,
  explanation struct<question_nature string, formulas_used array<string>, estimated_time_minutes int>,
  hierarchical_tags struct<subject struct<name string, confidence double>, topic struct<name string, syllabus_ref string>, concepts array<struct<name string, importance string, consensus string>>>,
  prerequisites struct<essential array<string>, helpful array<string>, dependency_tree map<string, array<string>>>,
  difficulty_analysis struct<overall string, score int>,
  textbook_references array<struct<book string, author string, chapter_title string, section string>>,
  video_references array<struct<professor string, topic_covered string, video_url string>>>,
tier_2_student_learning struct<exam_strategy struct<priority string, triage_tip string>>,
tier_3_enhanced_learning struct<search_keywords array<string>, deeper_dive_topics array<string>>,
tier_4_metadata_and_future struct<question_metadata struct<id string, year int>>"""


def silver(records: DataFrame, text: str) -> DataFrame:
    """Rows of ``records`` with a readable record, and its typed sections in place of the text.

    A record inside a fence, a list of one or a ``response_json`` object is taken
    out of it.
    """
    v = tolerant_json(F.col(text))
    inner = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    bare = F.coalesce(F.try_variant_get(inner, "$.response_json", "variant"), inner)
    typed = records.withColumn("_r", F.from_json(F.to_json(bare), RECORD)).where("_r is not null")
    return typed.select(*[c for c in records.columns if c != text], "_r.*")


def _edges(rows: DataFrame, source: Column, kind: str, target: Column, types: tuple[str, str]) -> DataFrame:
    return rows.select(
        source.alias("source"), F.lit(kind).alias("edge_type"), target.alias("target"), F.lit(types[0]).alias("source_type"), F.lit(types[1]).alias("target_type")
    ).where("trim(source) <> '' and trim(target) <> ''")


def knowledge_edges(rows: DataFrame, question: str = "question_id") -> DataFrame:
    """``(source, edge_type, target, source_type, target_type)`` of all that typed records name; repeated edges stay."""
    q, t1 = F.col(question), "tier_1_core_research"
    tags = f"{t1}.hierarchical_tags"
    subject, topic = F.trim(f"{tags}.subject.name"), F.trim(f"{tags}.topic.name")
    each = lambda c, **cols: rows.select(q.alias("q"), topic.alias("topic"), F.explode(c).alias("x"), *[v.alias(k) for k, v in cols.items()])
    concept = F.trim("x.name")
    concepts = each(f"{tags}.concepts")
    tree = rows.select(q.alias("q"), F.explode(f"{t1}.prerequisites.dependency_tree").alias("concept", "said")).select("q", "concept", F.explode("said").alias("s"))
    after = lambda p: F.trim(F.replace(F.col("s"), F.lit(p), F.lit("")))
    book = F.concat_ws(" - ", F.col("x.book"), F.col("x.author"))
    video = F.left(F.concat_ws(" - ", F.col("x.professor"), F.col("x.topic_covered")), F.lit(100))
    parts = [
        _edges(rows, topic, "PART_OF", subject, ("topic", "subject")),
        _edges(concepts, F.col("q"), "TESTS", concept, ("question", "concept")),
        _edges(concepts, concept, "BELONGS_TO", F.col("topic"), ("concept", "topic")),
        _edges(each(f"{t1}.prerequisites.essential"), F.col("q"), "REQUIRES", F.trim("x"), ("question", "concept")),
        _edges(each(f"{t1}.prerequisites.helpful"), F.col("q"), "BENEFITS_FROM", F.trim("x"), ("question", "concept")),
        _edges(tree.where(F.col("s").startswith("requires:")), F.col("concept"), "REQUIRES", after("requires:"), ("concept", "concept")),
        _edges(tree.where(F.col("s").startswith("enables:")), F.col("concept"), "ENABLES", after("enables:"), ("concept", "concept")),
        _edges(each(f"{t1}.explanation.formulas_used"), F.col("q"), "USES_FORMULA", tx.formula_id(F.col("x")), ("question", "formula")),
        _edges(each(f"{t1}.textbook_references"), F.col("q"), "REFERENCES", book, ("question", "book")),
        _edges(each(f"{t1}.video_references"), F.col("q"), "HAS_VIDEO", video, ("question", "video")),
        _edges(rows, q, "HAS_DIFFICULTY", F.coalesce(F.col("tier_0_classification.difficulty_score"), F.col(f"{t1}.difficulty_analysis.score")).cast("string"), ("question", "difficulty")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knowledge_nodes(edges: DataFrame) -> DataFrame:
    """``(node_type, node_id, n)``: nodes by type and id, so that one name of two types stays two nodes."""
    ends = F.array(F.struct(F.col("source_type").alias("node_type"), F.col("source").alias("node_id")), F.struct(F.col("target_type").alias("node_type"), F.col("target").alias("node_id")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node_type", "e.node_id").agg(F.count("*").alias("n"))
