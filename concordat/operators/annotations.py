"""What is done with annotation records around the vote: field consensus, metrics, references, judge replies, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.ordering import ranked, running_sum
from concordat.operators.telemetry import rolling_mean

# The lists, texts and numbers of a record that its metrics look at.
LISTS = (
    "tier_1_core_research.explanation.step_by_step", "tier_1_core_research.explanation.formulas_used", "tier_1_core_research.hierarchical_tags.concepts",
    "tier_1_core_research.prerequisites.essential", "tier_1_core_research.prerequisites.helpful", "tier_1_core_research.textbook_references",
    "tier_1_core_research.video_references", "tier_1_core_research.formulas_principles", "tier_1_core_research.real_world_applications.industry_examples",
    "tier_2_student_learning.common_mistakes", "tier_2_student_learning.mnemonics_memory_aids", "tier_2_student_learning.flashcards",
    "tier_2_student_learning.real_world_context", "tier_3_enhanced_learning.search_keywords", "tier_3_enhanced_learning.alternative_methods",
    "tier_3_enhanced_learning.deeper_dive_topics",
)
TEXTS = ("tier_1_core_research.answer_validation.reasoning", "tier_1_core_research.real_world_applications.practical_relevance")
NUMBERS = ("tier_1_core_research.answer_validation.confidence", "tier_0_classification.classification_confidence", "tier_1_core_research.difficulty_analysis.score")


def field_consensus(rows: DataFrame, keys: list[str], flag: Column, identities: list[str], numbers: list[str], weight: Column) -> DataFrame:
    """``(keys, red_line, <identities>, <numbers>, n_disputed)``: the whole vote on a group's fields in two grouped passes.

    red_line: whether any answer denies the flag; identities take their most frequent value, the smallest on a tie;
    numbers their weighted mean over the values that are there; n_disputed counts the identities on which no value
    has more than half of the votes. A group without a value has null there.
    """
    base = rows.withColumns({"_flag": flag, "_w": weight})
    means = [(F.sum(F.when(F.col(n).isNotNull(), F.col(n) * F.col("_w"))) / F.nullif(F.sum(F.when(F.col(n).isNotNull(), F.col("_w"))), F.lit(0.0))).alias(n) for n in numbers]
    whole = base.groupBy(*keys).agg(F.coalesce(F.bool_or(~F.col("_flag")), F.lit(False)).alias("red_line"), *means)
    said = base.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(i).cast("string").alias("value")) for i in identities])).alias("s")).select(*keys, "s.*")
    votes = said.where("value is not null").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("best")
    fields = votes.groupBy(*keys, "field").agg(best, F.sum("n").alias("all"))
    picked = fields.groupBy(*keys).agg(
        *[F.max(F.when(F.col("field") == i, F.col("best.value"))).alias(i) for i in identities], F.count_if(-2 * F.col("best.o") <= F.col("all")).alias("n_disputed")
    )
    return whole.join(picked, keys, "left").withColumn("n_disputed", F.coalesce("n_disputed", F.lit(0)))


def completeness(leaves: DataFrame, row_id: str) -> DataFrame:
    """``(row_id, fields, filled, share)`` from the leaves of records: a list is one field, filled if any element is not null.

    Elements of a list count for the list that holds them, an empty object outside lists counts for nothing, an
    empty text is not filled.
    """
    outer = F.regexp_extract("path", r"^((?:`[^`]*`|[^\[`])*)", 1)
    listed = F.length(outer) < F.length("path")
    # a leaf below an element shows that the element is an object or a list, whatever it holds
    within = F.substring("path", F.length(outer) + 1, F.length("path")).rlike(r"^\[\d+\].")
    filled = F.when(listed, within | (F.col("type") != "null")).otherwise(~F.col("value").isin("null", '""', "[]"))
    fields = leaves.where(listed | ~((F.col("type") == "object") & (F.col("value") == "{}"))).groupBy(row_id, outer.alias("field")).agg(F.bool_or(filled).alias("filled"))
    counts = fields.groupBy(row_id).agg(F.count("*").alias("fields"), F.count_if("filled").alias("filled"))
    return counts.withColumn("share", F.col("filled") / F.col("fields"))


def record_metrics(records: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, <one count per list>, n_items, n_formulas, text_length, <numbers>)`` of every readable record.

    Null elements do not count; a list, text or number of another kind counts as absent.
    """
    parsed = records.where(F.try_parse_json(text).isNotNull()).select(row_id, F.explode(F.array(F.try_parse_json(text))).alias("_v"))
    at = lambda p, kind: F.try_variant_get("_v", f"$.{p}", kind)
    name = lambda p: p.rsplit(".", 1)[-1]
    counts = [F.coalesce(F.size(F.filter(at(p, "array<variant>"), lambda x: ~F.is_variant_null(x))), F.lit(0)).alias(name(p)) for p in LISTS]
    is_text = lambda p: F.schema_of_variant(at(p, "variant")) == "STRING"
    is_number = lambda p: F.schema_of_variant(at(p, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    length = sum((F.coalesce(F.when(is_text(p), F.length(at(p, "string"))), F.lit(0)) for p in TEXTS), F.lit(0))
    numbers = [F.when(is_number(p), at(p, "double")).alias(name(p)) for p in NUMBERS]
    out = parsed.select(row_id, *counts, length.alias("text_length"), *numbers)
    total = sum((F.col(name(p)) for p in LISTS), F.lit(0))
    return out.withColumns({"n_items": total, "n_formulas": F.col("formulas_principles") + F.col("formulas_used")})


def run_metadata(rows: DataFrame, keys: list[str], model: str, stage: str, seconds: str, tokens: str) -> DataFrame:
    """``(keys, n_models, tokens, seconds, slowest, by_model)``: sums, the stage with most seconds, and tokens per model as ``m=n|...``."""
    stages = rows.groupBy(*keys, stage).agg(F.sum(seconds).alias("s")).groupBy(*keys).agg(
        F.min(F.when(F.col("s").isNotNull(), F.struct((-F.round("s", 6)).alias("o"), F.col(stage).alias("v"))))["v"].alias("slowest"), F.sum("s").alias("seconds")
    )
    models = rows.where(F.col(model).isNotNull()).groupBy(*keys, model).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("t")).groupBy(*keys).agg(
        F.count("*").alias("n_models"), F.sum("t").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(model, "t"))), lambda x: F.concat_ws("=", x[model], x["t"].cast("string"))), "|").alias("by_model"),
    )
    return stages.join(models, keys, "left")


def storage_statistics(rows: DataFrame, keys: list[str], text: str, at: str) -> DataFrame:
    """``(keys, entries, characters, oldest, newest)`` of a cache."""
    return rows.groupBy(*keys).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def resume_info(expected: DataFrame, done: DataFrame, keys: list[str], group: str) -> DataFrame:
    """``(group, total, done, remaining, done_share)``: how far a run has come, without collecting what is done."""
    marked = expected.select(group, *keys).distinct().join(done.select(*keys).distinct().withColumn("_d", F.lit(1)), keys, "left")
    out = marked.groupBy(group).agg(F.count("*").alias("total"), F.count("_d").alias("done"))
    return out.withColumns({"remaining": F.col("total") - F.col("done"), "done_share": F.col("done") / F.col("total")})


def remaining_time(rows: DataFrame, group: str, order: list[str], seconds: str) -> DataFrame:
    """Rows with ``eta``: the number of rows of their group still to come times the mean of the newest hundred durations."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    placed = ranked(rolling_mean(rows, group, order, seconds), [group], order, "_at")
    return placed.join(sizes, group).withColumn("eta", (F.col("_n") - F.col("_at") - 1) * F.col("rolling_mean")).drop("_n", "_at")


def seeded_sample(rows: DataFrame, group: str, row_id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, the same for one seed however rows are partitioned: those with the smallest hash of seed and id."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, row_id))).where(F.col("_r") <= n).drop("_r")


def affordable(rows: DataFrame, group: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """The rows of each group up to the last before its costs exceed the limit; costs are not negative, a null one is free."""
    sums = running_sum(rows.withColumn("_cost", F.coalesce(F.col(cost), F.lit(0.0))), [group], order, "_cost", "_sum")
    return sums.where(F.round("_sum", 6) <= limit).select(rows.columns)


def shown(value: Column, limit: int = 60) -> Column:
    """A value for reading: ``[EMPTY/MISSING]`` where there is none, cut and marked where it is long."""
    cut = F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("..."))).otherwise(value)
    return F.when(F.coalesce(F.trim(value) == "", F.lit(True)), "[EMPTY/MISSING]").otherwise(cut)


def reference(kind: Column, title: Column, *parts: Column) -> Column:
    """``kind: title, part, ...`` without the parts that are missing or blank."""
    there = F.filter(F.array(title, *parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.concat(kind, F.lit(": "), F.array_join(there, ", "))


def field_key(path: Column) -> Column:
    """A leaf's path as a key: dots and opening brackets become underscores, closing ones go."""
    return F.translate(path, ".[]", "__")


def judge_reply(reply: Column) -> Column:
    """The winner that a judge's reply names: its JSON, the outermost braces in it, or a pattern for the pair; null where none does."""
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    pick = lambda v: F.try_variant_get(F.try_parse_json(v), "$.winner", "string")
    pair = F.nullif(F.regexp_extract(reply, r"winner\W{1,8}(\w+)", 1), F.lit(""))
    return F.coalesce(pick(reply), pick(braces), pair)


def template_problems(text: Column, declared: list[str]) -> Column:
    """Struct of the undeclared and the unused variables of a template (sorted) and whether its braces balance."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([A-Za-z_]+)\}"), F.lit(1))))
    known = F.array(*[F.lit(d) for d in sorted(declared)])
    balanced = F.length(F.translate(text, "{", "")) == F.length(F.translate(text, "}", ""))
    return F.struct(F.array_except(names, known).alias("undeclared"), F.array_except(known, names).alias("unused"), balanced.alias("balanced"))


def new_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, edge_type)``: nodes outside the set that an edge in either direction ties to it."""
    both = edges.select("source", "target", "edge_type").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type"))
    reached = both.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node"), "edge_type").distinct()
    return reached.join(nodes.select("node"), "node", "left_anti")
