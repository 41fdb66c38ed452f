"""One consistent table from files whose fields drift, and a report of every change.

Ingestion enforces a target schema and rescues what does not fit: unknown fields and
values of another kind stay beside the row as JSON, so nothing is lost. The report
reads typed columns and rescued values alike. Fields approved later are replayed
from the rescued values into their typed columns without reading the files again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.components import connected_components
from concordat.runtime import cut_lineage

#: Kinds of JSON values a target field may ask for, and how each is stored.
KINDS = {"text": "string", "number": "double", "boolean": "boolean", "list": "string", "object": "string"}
#: The record that files of every feed are brought to.
TARGET = {
    "model_name": "text",
    "classifier_model": "text",
    "classification_method": "text",
    "classification_confidence": "number",
    "difficulty_score": "number",
    "question_id": "text",
    "tokens_used": "number",
    "media_type": "text",
}
FILE = ("feed", "file_no")
#: Stands for a null feed within a report, so that joins keep it.
_NO_FEED = "\u0000"


def _kind(value: Column) -> Column:
    """Kind of a JSON value given as compact JSON text."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first == '"', "text").when(first == "{", "object").when(first == "[", "list")
        .when(first.isin("t", "f"), "boolean").when(value != "null", "number")
    )


def ingest(lines: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """``(feed, file_no, line_no, <target fields>, _rescued, _nulls)`` of every readable line, once.

    A line is readable if its payload is one JSON object. A field of the target
    keeps values of its kind; any other value, and any unknown field, stays in the
    map ``_rescued`` as JSON text. ``_nulls`` names the fields that a line carries
    as null. Lines with one feed, file and line number are one line sent again, of
    which a readable one is kept; lines without these stand each for itself under null.
    Extra columns are ignored, an empty table stays empty.
    """
    is_object = F.ltrim("payload").startswith("{") & F.try_parse_json("payload").isNotNull()
    readable = lines.select(*FILE, "line_no", "payload").where(is_object)
    keyed = F.col("feed").isNotNull() & F.col("file_no").isNotNull() & F.col("line_no").isNotNull()
    once = readable.where(keyed).groupBy(*FILE, "line_no").agg(F.min("payload").alias("payload"))
    parsed = once.unionByName(readable.where(~keyed)).withColumn("_v", F.try_parse_json("payload"))
    values = parsed.select(*FILE, "line_no", F.expr("transform_values(cast(_v as map<string, variant>), (k, v) -> to_json(v))").alias("_all"))
    at = {f: F.element_at("_all", F.lit(f)) for f in target}
    fits = {f: F.coalesce(_kind(at[f]) == kind, F.lit(False)) for f, kind in target.items()}
    typed = [
        F.when(fits[f], (F.get_json_object(F.concat(F.lit('{"v":'), at[f], F.lit("}")), "$.v") if kind == "text" else at[f]).try_cast(KINDS[kind])).alias(f)
        for f, kind in target.items()
    ]
    known = F.create_map(*[x for f, kind in target.items() for x in (F.lit(f), F.lit(kind))])
    left = F.map_filter("_all", lambda k, v: F.coalesce(v != "null", F.lit(False)) & ~F.coalesce(F.element_at(known, k) == _kind(v), F.lit(False)))
    nulls = F.map_keys(F.map_filter("_all", lambda k, v: F.coalesce(v == "null", F.lit(True))))
    return values.select(*FILE, "line_no", *typed, left.alias("_rescued"), nulls.alias("_nulls"))


def _as_json(field: str, kind: str) -> Column:
    if kind == "text":
        return F.substring(F.to_json(F.struct(F.col(field).alias("v"))), 6, 1 << 30)
    return F.col(field).cast("string")


def kinds_seen(ingested: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """``(feed, file_no, field, kind)``: every field of every ingested line without its value; kind is null for a null."""
    entry = lambda f, k: F.struct(f.alias("field"), k.cast("string").alias("kind"))
    typed = F.array(*[F.when(F.col(f).isNotNull(), entry(F.lit(f), F.lit(k))) for f, k in target.items()])
    rescued = F.transform(F.map_entries("_rescued"), lambda e: entry(e["key"], _kind(e["value"])))
    every = F.concat(F.filter(typed, lambda e: e.isNotNull()), rescued, F.transform("_nulls", lambda n: entry(n, F.lit(None))))
    return ingested.select(*FILE, F.inline(every))


def contents_of(ingested: DataFrame, fields: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """``(feed, file_no, field, kind, value, <further columns of fields>)``: what the lines of files hold in the given fields.

    ``fields`` has feed, file_no, field and any further columns; its rows of a file, at most a few per field, ride
    along with the file's lines, and only their values are worked out.
    """
    more = [c for c in fields.columns if c not in (*FILE, "field")]
    wanted = fields.groupBy(*FILE).agg(F.collect_list(F.struct("field", *more)).alias("_wanted"))
    rows = ingested.join(wanted, list(FILE)).select(*FILE, *target, "_rescued", F.explode("_wanted").alias("_w"))
    typed = [F.when(F.col("_w.field") == f, F.when(F.col(f).isNotNull(), F.struct(F.lit(k).alias("kind"), _as_json(f, k).alias("value")))) for f, k in target.items()]
    kept = F.element_at("_rescued", F.col("_w.field"))
    said = F.coalesce(*typed, F.when(kept.isNotNull(), F.struct(_kind(kept).alias("kind"), kept.alias("value"))))
    return rows.select(*FILE, "_w.field", said.alias("_s"), *[F.col(f"_w.{c}") for c in more]).where("_s is not null").select(*FILE, "field", "_s.kind", "_s.value", *more)


def file_fields(seen: DataFrame, sizes: DataFrame, min_share: float) -> DataFrame:
    """``(feed, file_no, field, type, n)`` of the fields that at least ``min_share`` of a file's lines carry.

    The type is the kind of most values, the first in the alphabet on a tie, null
    where all values are null.
    """
    kinds = seen.groupBy(*FILE, "field", "kind").agg(F.count("*").alias("k"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("k"), (-F.ascii("kind")).alias("a"), F.col("kind")))).alias("best")
    fields = kinds.groupBy(*FILE, "field").agg(F.sum("k").alias("n"), best)
    return fields.join(sizes, list(FILE)).where(F.col("n") >= min_share * F.col("n_lines")).select(*FILE, "field", F.col("best.kind").alias("type"), "n")


def _atoms(value: Column, kind: Column) -> tuple[Column, Column]:
    """What a value says: its words and numbers as they are, and their shapes."""
    number = F.array(value.try_cast("double").cast("string"))
    words = F.when(kind == "number", number).when(kind == "boolean", F.array(value)).otherwise(
        F.regexp_extract_all(value, F.lit(r'"((?:[^"\\]|\\.)*)"(?!\s*:)'), F.lit(1))
    )
    numbers = F.when(kind == "list", F.regexp_extract_all(value, F.lit(r"(?<![\"\w.])-?\d+(?:\.\d+)?(?![\"\w.])"), F.lit(0)))
    words = F.concat(words, F.coalesce(numbers, F.array().cast("array<string>")))

    def shape(w: Column) -> Column:
        x = w.try_cast("double")
        size = F.concat(F.when(x == F.floor(x), "whole").otherwise("real"), F.when(x < 0, "-").otherwise("+"), F.floor(F.log2(F.abs(x) + 0.001)).cast("string"))
        letters = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\d+", "9")
        return F.coalesce(size, letters)

    return words, F.transform(words, shape)


def drift_report(
    lines_ingested: DataFrame, target: dict[str, str] = TARGET, min_share: float = 0.2, same_values: float = 0.3, same_shapes: float = 0.6
) -> DataFrame:
    """``(feed, file_no, change_kind, old_field, new_field)``: every change of a file against its feed's previous one.

    Files follow each other by number, gaps or not. A removed and an added field of
    one file are a rename if their contents agree: fields with few different values
    by the shared share of those (``same_values``), others by the shares of the
    shapes of their values (``same_shapes``); booleans, which always look alike,
    only where the names do. Of several partners the best on both sides counts. A
    null feed is a feed of its own; lines without a file number belong to no file, files without a readable line are not there.
    """
    ingested = cut_lineage(lines_ingested.where("file_no is not null").withColumn("feed", F.coalesce("feed", F.lit(_NO_FEED))))
    sizes = ingested.groupBy(*FILE).agg(F.count("*").alias("n_lines"))
    fields = cut_lineage(file_fields(kinds_seen(ingested, target), sizes, min_share))
    order = Window.partitionBy("feed").orderBy("file_no")
    files = sizes.select(*FILE, F.lag("file_no").over(order).alias("before"), F.lead("file_no").over(order).alias("after"))
    now = fields.join(files, list(FILE)).where("before is not null").select("feed", "file_no", "field", F.col("type").alias("new_type"))
    old = fields.join(files, list(FILE)).where("after is not null").select("feed", F.col("after").alias("file_no"), "field", F.col("type").alias("old_type"))
    both = now.withColumn("in_new", F.lit(True)).join(old.withColumn("in_old", F.lit(True)), ["feed", "file_no", "field"], "full_outer")
    both = cut_lineage(both)
    retyped = both.where("in_new and in_old and new_type <> old_type").select("feed", "file_no", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    added = both.where("in_old is null").select("feed", "file_no", "field", F.col("new_type").alias("type"))
    removed = both.where("in_new is null").select("feed", "file_no", "field", F.col("old_type").alias("type"))

    # contents of the fields that came or went, as shares of their words and shapes
    came = added.select("feed", F.col("file_no").alias("in_file"), "field", F.col("file_no").alias("change"), F.lit("new").alias("side"))
    went = removed.join(files, ["feed", "file_no"]).select("feed", F.col("before").alias("in_file"), "field", F.col("file_no").alias("change"), F.lit("old").alias("side"))
    moved = came.unionByName(went)
    words, shapes = _atoms(F.col("value"), F.col("kind"))
    content = contents_of(ingested, moved.withColumnRenamed("in_file", "file_no"), target).select("feed", "change", "side", "field", words.alias("w"), shapes.alias("s"))
    pieces = content.select("feed", "change", "side", "field", F.explode(F.concat(F.transform("w", lambda x: F.struct(F.lit("w").alias("of"), x.alias("atom"))), F.transform("s", lambda x: F.struct(F.lit("s").alias("of"), x.alias("atom"))))).alias("a")).select("feed", "change", "side", "field", "a.of", "a.atom")
    counts = pieces.groupBy("feed", "change", "side", "field", "of", "atom").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feed", "change", "side", "field", "of").agg(F.sum("n").alias("total"), F.count("*").alias("different"))
    shares = cut_lineage(counts.join(totals, ["feed", "change", "side", "field", "of"]).withColumn("p", F.col("n") / F.col("total")))
    side = lambda s, name: shares.where(F.col("side") == s).select("feed", "change", "of", "atom", F.col("field").alias(name), F.col("p").alias(f"p_{s}"))
    overlap = (
        side("old", "old_field").join(side("new", "new_field"), ["feed", "change", "of", "atom"])
        .groupBy("feed", "change", "old_field", "new_field")
        .agg(*[F.sum(F.when(F.col("of") == o, F.least("p_old", "p_new")).otherwise(0.0)).alias(o) for o in ("w", "s")])
    )
    few = totals.where("of = 'w'").select("feed", "change", "side", "field", (F.col("different") <= 0.6 * F.col("total")).alias("few"))
    typed = both.select("feed", F.col("file_no").alias("change"), "field", F.coalesce("new_type", "old_type").alias("type"))
    pair = (
        overlap.join(few.where("side = 'old'").select("feed", "change", F.col("field").alias("old_field"), F.col("few").alias("few_old")), ["feed", "change", "old_field"])
        .join(few.where("side = 'new'").select("feed", "change", F.col("field").alias("new_field"), F.col("few").alias("few_new")), ["feed", "change", "new_field"])
        .join(typed.withColumnsRenamed({"field": "old_field", "type": "old_type"}), ["feed", "change", "old_field"])
        .join(typed.withColumnsRenamed({"field": "new_field", "type": "new_type"}), ["feed", "change", "new_field"])
    )
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    alike = F.levenshtein(bare("old_field"), bare("new_field")) <= 0.34 * F.greatest(F.length("old_field"), F.length("new_field"))
    by_values = F.col("few_old") | F.col("few_new")
    score = F.when(F.col("old_type") == "boolean", F.when(alike, 1.0).otherwise(0.0)).when(by_values, F.col("w")).otherwise(F.greatest("w", "s"))
    enough = F.when(by_values, F.col("score") >= same_values).otherwise(F.col("score") >= same_shapes)
    scored = pair.withColumn("score", score + F.when(alike, 0.05).otherwise(0.0)).where(enough)
    rank = lambda by, other: F.row_number().over(Window.partitionBy("feed", "change", by).orderBy(F.desc("score"), other))
    renamed = cut_lineage(
        scored.withColumn("r_old", rank("old_field", "new_field")).withColumn("r_new", rank("new_field", "old_field"))
        .where("r_old = 1 and r_new = 1")
        .select("feed", F.col("change").alias("file_no"), F.lit("renamed").alias("change_kind"), "old_field", "new_field")
    )
    key = ["feed", "file_no", "field"]
    gone = removed.join(renamed.select("feed", "file_no", F.col("old_field").alias("field")), key, "left_anti")
    come = added.join(renamed.select("feed", "file_no", F.col("new_field").alias("field")), key, "left_anti")
    report = (
        renamed.unionByName(retyped)
        .unionByName(come.select("feed", "file_no", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("field").alias("new_field")))
        .unionByName(gone.select("feed", "file_no", F.lit("removed").alias("change_kind"), F.col("field").alias("old_field"), F.lit("").alias("new_field")))
    )
    return report.withColumn("feed", F.nullif("feed", F.lit(_NO_FEED)))


def approved_names(report: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """``(feed, field, target_field)``: names that a chain of reported renames ties to one field of the target."""
    tied = report.where("change_kind = 'renamed' and feed is not null")
    name = lambda c: F.concat_ws("\u0001", "feed", c)
    groups = connected_components(tied.select(name("old_field").alias("src"), name("new_field").alias("dst")))
    split = groups.select("component", F.substring_index("node", "\u0001", 1).alias("feed"), F.substring_index("node", "\u0001", -1).alias("field"))
    roots = split.where(F.col("field").isin(*target)).groupBy("component").agg(F.min("field").alias("target_field"), F.count("*").alias("n")).where("n = 1")
    return split.join(roots, "component").where("field <> target_field").select("feed", "field", "target_field")


def _names_of(target_field: str) -> Column:
    """Rescued values of a line under names approved for the target field."""
    return F.map_filter("_rescued", lambda k, v: F.coalesce(F.element_at(F.col("_to"), k) == F.lit(target_field), F.lit(False)))


def promote(ingested: DataFrame, approved: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """``ingested`` with rescued values of approved names, and of a field's own other kinds, replayed into typed columns.

    A text takes a number's digits, a lone list element, or an object's ``name``; a
    number takes a text that reads as one. What is replayed leaves ``_rescued``; what
    still does not fit stays there.
    """
    names = approved.groupBy("feed").agg(F.map_from_entries(F.collect_set(F.struct("field", "target_field"))).alias("_to"))
    rows = ingested.join(names, "feed", "left").withColumn("_to", F.coalesce("_to", F.create_map().cast("map<string,string>")))
    out = {}
    taken = F.array().cast("array<string>")
    for f, kind in target.items():
        own, same = F.element_at("_rescued", F.lit(f)), _names_of(f)
        raw = F.coalesce(F.get(F.map_values(same), 0), own)
        wrapped = F.concat(F.lit('{"v":'), raw, F.lit("}"))
        plain = F.coalesce(
            F.when(_kind(raw) == "object", F.get_json_object(wrapped, "$.v.name")), F.when(_kind(raw) == "list", F.get_json_object(wrapped, "$.v[0]")),
            F.when(_kind(raw).isin("text", "number", "boolean"), F.get_json_object(wrapped, "$.v")),
        )
        value = plain.try_cast(KINDS[kind]) if kind in ("text", "number", "boolean") else F.when(_kind(raw) == kind, raw)
        out[f] = F.coalesce(F.col(f), value)
        hit = F.when(F.size(same) > 0, F.slice(F.map_keys(same), 1, 1)).otherwise(F.array(F.lit(f)))
        taken = F.concat(taken, F.when(F.col(f).isNull() & value.isNotNull(), hit).otherwise(F.array().cast("array<string>")))
    left = F.map_filter("_rescued", lambda k, v: ~F.array_contains(F.col("_taken"), k))
    rows = rows.withColumn("_taken", taken)
    return rows.select(*FILE, "line_no", *[c.alias(f) for f, c in out.items()], left.alias("_rescued"), "_nulls")
