"""Property graph of annotations: extraction, degrees, components, neighbourhoods, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.operators.components import connected_components
from concordat.runtime import cut_lineage


def edge_projection(rows: DataFrame, source: Column, kind: str, target: Column, source_type: str, target_type: str) -> DataFrame:
    """``(source, edge_type, target, source_type, target_type)``; blank ends give no edge."""
    edges = rows.select(source.alias("source"), F.lit(kind).alias("edge_type"), target.alias("target"), F.lit(source_type).alias("source_type"), F.lit(target_type).alias("target_type"))
    return edges.where("trim(source) <> '' and trim(target) <> ''")


def annotation_graph(children: DataFrame, responses: DataFrame) -> DataFrame:
    """Edges from questions to what their responses hold, from the flat child tables (with values) of the records."""
    named = children.join(responses.select("response_id", "question_id"), "response_id").where("question_id is not null")
    value = F.col("value")
    text_of = lambda name: F.coalesce(F.get_json_object(value, f"$.{name}"), F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")))
    parts = [
        edge_projection(named.where("child = 'formulas_principles'"), F.col("question_id"), "USES_FORMULA", tx.formula_id(text_of("formula")), "question", "formula"),
        edge_projection(named.where("child = 'common_mistakes'"), F.col("question_id"), "HAS_MISTAKE", tx.text_id(text_of("mistake")), "question", "mistake"),
        edge_projection(named.where("child = 'content_type'"), F.col("question_id"), "HAS_TYPE", text_of("x"), "question", "content_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes_of(edges: DataFrame) -> DataFrame:
    """``(node)``: every end of an edge once."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, out_degree, in_degree, degree)``; repeated edges count each."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return sums.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "source", "target")


def neighbourhood(edges: DataFrame, centre: DataFrame, hops: int = 2) -> DataFrame:
    """``(node, hop)``: nodes within some steps of the centre nodes, in either direction."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    seen = centre.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        reached = both.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, size of the largest."""
    labelled = cut_lineage(components(edges))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    nodes = sizes.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("isolated"))
    n_edges = edges.where("source is not null and target is not null").count()
    density = F.lit(n_edges) / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0))
    return nodes.select("nodes", F.lit(n_edges).cast("long").alias("edges"), density.alias("density"), "components", "largest", "isolated")


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``(node, rank)`` summing to 1; what nodes without an outgoing edge hold is shared by all."""
    links = cut_lineage(edges.groupBy("source", "target").agg(F.count("*").alias("w")))
    out = links.groupBy("source").agg(F.sum("w").alias("out_w"))
    weighted = cut_lineage(links.join(out, "source").select("source", "target", (F.col("w") / F.col("out_w")).alias("p")))
    nodes = cut_lineage(nodes_of(edges))
    n = max(nodes.count(), 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for turn in range(rounds):
        given = weighted.join(ranks.withColumnRenamed("node", "source"), "source").groupBy("target").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        passed = nodes.join(given.withColumnRenamed("target", "node"), "node", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        passed = cut_lineage(passed) if turn % 3 == 2 or turn == rounds - 1 else passed
        kept = passed.agg(F.sum("got").alias("s")).first()["s"] or 0.0
        ranks = passed.select("node", ((1 - damping) / n + damping * (F.col("got") + (1 - kept) / n)).alias("rank"))
    return ranks


def type_histogram(edges: DataFrame, column: str = "edge_type") -> DataFrame:
    return edges.groupBy(column).agg(F.count("*").alias("n"))
