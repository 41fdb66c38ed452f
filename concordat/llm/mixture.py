"""A mixture of sources with given shares of all tokens, drawn by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.runtime import broadcast_if_small, cut_lineage


def mixture_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, n_tokens, budget, copies)``: how often each source's documents are wanted.

    ``sizes`` has source and n_tokens per document. Without ``total_tokens`` the
    mixture is as large as all targets allow: the scarcest source at its cap sets
    the size. With it, a source that cannot reach its share gives what its cap
    allows. A source without tokens, target or cap takes no part; repeated targets
    of a source add up to one with the smallest cap.
    """
    have = sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    wanted = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    both = wanted.join(have, "source").where("n_tokens > 0")
    reach = both.agg(F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")).alias("m")).first()["m"]
    total = F.lit(float(reach or 0.0) if total_tokens is None else float(total_tokens))
    copies = F.least(F.col("target_share") * total / F.col("n_tokens"), F.col("max_repeats").cast("double"))
    return both.withColumn("budget", F.col("target_share") * total).withColumn("copies", copies)


def draw_mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, copy)``: one row per use of a document, copy counting from 0.

    ``documents`` has doc_id, source and n_tokens. Within a source, documents lie
    one behind the other by size, each as long as its expected number of copies; a
    ruler with marks at every integer, moved by one random offset, gives a document
    one copy per mark on it. So each is used floor or ceil of that number, never
    more than the cap, and neighbours of like size even each other out. Documents
    of no tokens, or of a source that is null or without a target, are left out.

    The positions come from a range partitioning by source and size: counts per
    source and partition, a few rows each, give every partition its start, so a
    source of any size spreads over all tasks.
    """
    documents = documents.select("doc_id", "source", "n_tokens")
    plan = mixture_plan(documents, targets, total_tokens).select("source", "copies")
    n_sources = plan.count()
    wanted = documents.where("n_tokens > 0").join(broadcast_if_small(plan, n_sources, 64), "source")
    ranged = wanted.repartitionByRange("source", "n_tokens", "doc_id").sortWithinPartitions("source", "n_tokens", "doc_id")
    # written once: the ranges come from a sample, and positions must refer to one drawing of them
    placed = cut_lineage(
        ranged.select("doc_id", "source", "n_tokens", "copies", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    starts = placed.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # a few rows per partition, whatever the data
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("source", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    n_offsets = placed.rdd.getNumPartitions() + n_sources
    offset = (F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rank = F.col("skip") + F.col("at") - F.col("first")
    marked = placed.join(broadcast_if_small(offsets, n_offsets, 96), ["source", "part"]).withColumn(
        "n", F.floor((rank + 1) * F.col("copies") + offset) - F.floor(rank * F.col("copies") + offset)
    )
    return marked.where("n > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))


def mixture_report(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, tokens, n_uses, most_uses, source_tokens)`` of every target source."""
    used = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_uses"), (F.max("copy") + 1).alias("most_uses")
    )
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    have = documents.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    grand = total.first()["all_tokens"] or 0
    return rows.join(used, "source", "left").join(have, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.nullif(F.lit(grand), F.lit(0))).alias("actual_share"),
        zero("tokens"), zero("n_uses"), zero("most_uses"), zero("source_tokens"),
    )
