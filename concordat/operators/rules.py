"""Rules for nested annotation records as data, and their compilation to Columns over a variant."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of every section with their kinds ("?" marks those that may be missing), the values
# and ranges that some are held to, the structs and the lists of structs inside.
ROOT = ("question_id", "exam_name", "subject", "year", "question_text", "question_type")


@dataclass(frozen=True)
class Shape:
    """What an object must hold: ``fields`` as ``name kind, name kind?``, allowed values, ranges, and the shapes inside."""

    fields: str
    allowed: dict[str, tuple] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    parts: dict[str, Shape] = field(default_factory=dict)
    lists: dict[str, Shape] = field(default_factory=dict)

    def kinds(self) -> list[tuple[str, str, bool]]:
        """Name, kind and whether the field must be there."""
        pairs = [f.split() for f in self.fields.split(",") if f.strip()]
        return [(name, kind.rstrip("?"), not kind.endswith("?")) for name, kind in pairs]


RECORD_SHAPES = {
    "tier_0_classification": Shape(
        "content_type text, media_type text, difficulty_score whole, complexity_flags object, use_gpt51 boolean, classification_confidence real, "
        "classification_reasoning text, weight_strategy text",
        allowed={
            "content_type": ("conceptual_theory", "mathematical_derivation", "numerical_calculation", "conceptual_application"),
            "media_type": ("text_only", "image_based"),
            "weight_strategy": (
                "BALANCED", "CONCEPTUAL_WEIGHTED", "MATH_WEIGHTED", "NUMERICAL_WEIGHTED", "APPLICATION_WEIGHTED", "VISION_WEIGHTED", "MATH_IMAGE_HYBRID",
            ),
        },
        ranges={"difficulty_score": (1, 10), "classification_confidence": (0, 1)},
        parts={
            "complexity_flags": Shape(
                "requires_derivation boolean, multi_concept_integration boolean, ambiguous_wording boolean, image_interpretation_complex boolean, "
                "edge_case_scenario boolean, multi_step_reasoning boolean, approximation_needed boolean"
            )
        },
    ),
    "tier_1_core_research": Shape(
        "answer_validation object, explanation object, hierarchical_tags object, prerequisites object, difficulty_analysis object, textbook_references list, "
        "video_references list, step_by_step_solution object, formulas_principles list, real_world_applications object",
        parts={
            "answer_validation": Shape("correct_answer text, is_correct boolean, confidence real, confidence_type text?, reasoning text"),
            "explanation": Shape("question_nature text, step_by_step list, formulas_used list, estimated_time_minutes whole?"),
            "hierarchical_tags": Shape(
                "subject object, topic object, concepts list", lists={"concepts": Shape("name text, importance text, consensus text?")}
            ),
            "prerequisites": Shape("essential list, helpful list?, dependency_tree object?"),
            "difficulty_analysis": Shape(
                "overall text, score whole, complexity_breakdown object?, difficulty_factors list?",
                allowed={"overall": ("Very Easy", "Easy", "Medium", "Hard", "Very Hard")}, ranges={"score": (1, 10)},
            ),
            "step_by_step_solution": Shape("approach_type text?, total_steps whole?, solution_path text?, key_insights list?"),
            "real_world_applications": Shape("industry_examples list?, specific_systems list?, practical_relevance text?"),
        },
        lists={
            "textbook_references": Shape("source_type text?, book text, author text, relevance_score real, source text"),
            "video_references": Shape("source_type text?, professor text, topic_covered text, relevance_score real, source text"),
            "formulas_principles": Shape("formula text, name text, relevance text"),
        },
    ),
    "tier_2_student_learning": Shape(
        "common_mistakes list, mnemonics_memory_aids list, flashcards list, real_world_context list, exam_strategy object",
        parts={
            "exam_strategy": Shape(
                "priority text, triage_tip text, guessing_heuristic text?, time_management text?",
                allowed={"priority": ("Must Attempt", "Attempt If Time", "Skip If Unsure")},
            )
        },
        lists={
            "common_mistakes": Shape("mistake text, type text, severity text, how_to_avoid text"),
            "mnemonics_memory_aids": Shape("mnemonic text, concept text"),
            "flashcards": Shape("card_type text, front text, back text"),
            "real_world_context": Shape("application text, industry_example text"),
        },
    ),
    "tier_3_enhanced_learning": Shape(
        "search_keywords list, alternative_methods list, connections_to_other_subjects object, deeper_dive_topics list",
        lists={"alternative_methods": Shape("name text, description text, pros_cons text")},
    ),
    "tier_4_metadata_and_future": Shape(
        "question_metadata object, syllabus_mapping object, rag_quality object, model_meta object, future_questions_potential list",
        parts={
            "question_metadata": Shape("id text, year whole, marks real"),
            "syllabus_mapping": Shape("gate_section text"),
            "rag_quality": Shape("relevance_score real, notes text, sources_distribution object?"),
            "model_meta": Shape("timestamp text, version text"),
        },
    ),
}


_KINDS = {"STRING": "text", "BIGINT": "whole", "DECIMAL": "real", "DOUBLE": "real", "FLOAT": "real", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "list", "VOID": "null"}


def kind_of(value: Column) -> Column:
    """text, whole, real, boolean, object, list or null of a variant; null where there is none. Reads the value once."""
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def fits(kind: Column, wanted: str) -> Column:
    """A boolean passes for a whole number, a whole number does not pass for a real one."""
    return kind.isin("whole", "boolean") if wanted == "whole" else kind == wanted


def _at(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _found(broken: Column, section: str, check: str, path: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(section).alias("section"), F.lit(check).alias("check"), path.alias("path")))


def _object_rules(value: Column, kinds: dict[str, Column], shape: Shape, section: str, path: Column, top: bool) -> list[Column]:
    """Entries, null where a rule holds, for an object whose fields have these kinds."""
    out = []
    for name, kind, must in shape.kinds():
        k, at = kinds[name], F.concat(path, F.lit("." + name))
        if must:
            out.append(_found(k.isNull(), section, "required", at))
        if top:
            out.append(_found(k == "null", section, "null", at))
        out.append(_found((k != "null") & ~fits(k, kind), section, "type", at))
        if name in shape.allowed:
            said = F.when(k == "text", _at(value, name, "string"))
            out.append(_found(k.isNotNull() & ~F.coalesce(said.isin(*shape.allowed[name]), F.lit(False)), section, "enum", at))
        if name in shape.ranges:
            low, high = shape.ranges[name]
            out.append(_found(~F.when(k.isin("whole", "real"), _at(value, name, "double")).between(low, high), section, "range", at))
    return out


def _list_rules(value: Column, kind: Column, shape: Shape, section: str, path: str) -> Column:
    """Entries of all elements, each with its place in its path; only an object is held to the shape."""

    def element(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        # kinds of a field are read once, in an array of one, and its rules then refer to that
        def rules_of(name: str, one: Shape) -> Column:
            return F.transform(F.array(kind_of(_at(x, name))), lambda k: F.array(*_object_rules(x, {name: k}, one, section, at, False)))

        fields = [rules_of(name, one) for name, one in single]
        return F.when(kind_of(x) == "object", F.flatten(F.flatten(F.array(*fields)))).otherwise(F.array(_found(F.lit(True), section, "element", at)))

    single = [(name, Shape(f"{name} {k}{'' if must else '?'}")) for name, k, must in shape.kinds()]
    items = F.coalesce(value.try_cast("array<variant>"), F.array().cast("array<variant>"))
    return F.when(kind == "list", F.flatten(F.transform(items, element))).otherwise(F.array().cast(_ENTRIES))


def _kept(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``frame`` with further columns, worked out once: an exploded array of one is not repeated wherever they are used."""
    named = [c.alias(n) for n, c in columns.items()]
    return frame.select("*", F.explode(F.array(F.struct(*named))).alias("_s")).select(*frame.columns, "_s.*")


def broken_rules(records: DataFrame, record: str, shapes: dict[str, Shape]) -> tuple[DataFrame, Column]:
    """``records`` with columns for the objects inside ``record``, and the array of broken rules as (section, check, path)."""
    tiers = {f"_t{i}": (section, shape) for i, (section, shape) in enumerate(shapes.items())}
    frame = _kept(records, {t: _at(F.col(record), section) for t, (section, _) in tiers.items()})
    parts = {f"{t}_{j}": (t, section, name, part) for t, (section, shape) in tiers.items() for j, (name, part) in enumerate(shape.parts.items())}
    frame = _kept(frame, {p: _at(F.col(t), name) for p, (t, _, name, _) in parts.items()})
    objects = [(t, section, section, shape, True) for t, (section, shape) in tiers.items()] + [(p, section, f"{section}.{name}", part, False) for p, (_, section, name, part) in parts.items()]
    kinds = {f"_k{o}": kind_of(F.col(o)) for o, *_ in objects}
    kinds |= {f"_k{o}_{n}": kind_of(_at(F.col(o), n)) for o, _, _, shape, _ in objects for n, _, _ in shape.kinds()}
    frame = _kept(frame, kinds)
    out = []
    for o, section, path, shape, top in objects:
        own = F.col(f"_k{o}")
        single = F.array(*_object_rules(F.col(o), {n: F.col(f"_k{o}_{n}") for n, _, _ in shape.kinds()}, shape, section, F.lit(path), top))
        lists = [_list_rules(_at(F.col(o), n), F.col(f"_k{o}_{n}"), s, section, f"{path}.{n}") for n, s in shape.lists.items()]
        within = F.concat(single, *lists) if lists else single
        if top:
            missing, other = F.array(_found(F.lit(True), "root", "required", F.lit(path))), F.array(_found(F.lit(True), section, "type", F.lit(path)))
            out.append(F.when(own.isNull(), missing).when(own != "object", other).otherwise(within))
        else:
            out.append(F.when(own == "object", within).otherwise(F.array().cast(_ENTRIES)))
    return frame, F.concat(*out)


_ENTRIES = "array<struct<section: string, check: string, path: string>>"
