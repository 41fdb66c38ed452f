"""Fuzzy agreement of texts within groups of any size: sequence ratio, linked texts, merged texts."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from concordat.functions import text as tx
from concordat.operators.components import connected_components
from concordat.runtime import broadcast_if_small, cut_lineage


def plain(text: str | None) -> str:
    """Lower-case ASCII letters and digits with single blanks."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", (text or "").lower())).strip()


def ratio(a: str, b: str) -> float:
    """Share of matching blocks of two plain texts; an empty one matches nothing."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(plain(x), plain(y)) for x, y in zip(a, b, strict=True)])


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similar_pairs(
    texts: DataFrame, keys: list[str], row_id: str, plain_text: str, threshold: float, shared_words: float = 0.7, links_only: bool = False, whole: int = 512, block: int = 4096
) -> DataFrame:
    """``(a, b)``: ids, the smaller first, of plain texts of one group that share words and have a sequence ratio of ``threshold``.

    Groups of at most ``whole`` texts are compared at once. In larger ones two texts whose sets of words have a Jaccard
    similarity of ``shared_words`` must share one of their rarest words, as many as could be missing and one more; so
    texts meet at those words within their group, and no pair above both limits is lost. Where more than ``block`` texts
    meet they do so block by block. Pairs that only meet are never rows: a task counts their shared words in bits and
    gives those that reach both limits. With ``links_only`` pairs that others already link are left out.
    ``row_id`` must be unique; blank texts have no partner, nor has a text without a key.
    """
    there = texts.where(F.col(plain_text).isNotNull()).dropna(subset=keys).select(*keys, F.col(row_id).alias("id"), F.col(plain_text).alias("p"))
    large = cut_lineage(there.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > whole).select(*keys))
    large = broadcast_if_small(large, large.count(), 256)
    unit = lambda *more: F.concat_ws("\x01", *[F.col(k).cast("string") for k in keys], *more)
    small = there.join(large, keys, "left_anti").select(unit().alias("unit"), F.lit(-1).alias("side"), "id", "p")

    crowded = there.join(large, keys, "left_semi")
    words = crowded.select(*keys, "id", "p", F.explode(F.array_distinct(F.split("p", " "))).alias("word")).where("word <> ''")
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    # a text is gathered to its own words, no more
    rare_first = words.drop("p").join(counts, [*keys, "word"]).groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words"))
    size = F.size("words")
    spare = size - F.ceil(F.lit(shared_words) * size - F.lit(1e-9)).cast("int") + 1
    marks = rare_first.select(*keys, "id", F.explode(F.slice("words", F.lit(1), spare)).alias("m")).where("m.n > 1").select(*keys, "id", "m.word", "m.n")
    # the word's count bounds how many meet at it
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = marks.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    place = [F.col("word"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")]
    met = spread.select(unit(*place).alias("unit"), side.alias("side"), "id").join(crowded.select("id", "p"), "id").select("unit", "side", "id", "p")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] | None = {} if links_only else None
        for sides, ids, plains in _units(batches):
            pairs = _alike(sides, ids, plains, threshold, shared_words, parent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

    # comparing takes time that sizes in bytes don't show, so tasks are not joined by them
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = small.unionByName(met).repartition(tasks, "unit").sortWithinPartitions("unit")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """``(sides, ids, texts)`` of the rows of one unit, which follow each other."""
    name, held = None, ([], [], [])
    for batch in batches:
        units, *columns = (c.to_pylist() for c in batch.columns)
        start = 0
        while start < len(units):
            end = bisect.bisect_right(units, units[start], start) if units[-1] != units[start] else len(units)
            if units[start] != name:
                if len(held[0]) > 1:
                    yield held
                name, held = units[start], ([], [], [])
            for to, column in zip(held, columns, strict=True):
                to.extend(column[start:end])
            start = end
    if len(held[0]) > 1:
        yield held


def _alike(sides: list, ids: list, plains: list, threshold: float, shared_words: float, parent: dict | None) -> list[tuple[int, int]]:
    """Pairs of a unit that reach both limits; where two sides meet only pairs across them, with ``parent`` only pairs that link what nothing has linked."""
    order = sorted((i for i in range(len(ids)) if plains[i].strip(" ")), key=ids.__getitem__)
    words = [set(plains[i].split(" ")) for i in order]
    codes: dict[str, int] = {}
    flat = [codes.setdefault(w, len(codes)) for ws in words for w in ws]
    n, sizes = len(order), np.array([len(ws) for ws in words], np.int64)
    if n < 2:
        return []
    width = min(-(-len(codes) // 64) * 64, 2048)
    held = np.zeros((n, width), bool)
    held[np.repeat(np.arange(n), sizes), np.array(flat) % width] = True
    bits = np.packbits(held, axis=1).view(np.uint64)
    lost = sizes - held.sum(1)  # words that share a bit with others: what is counted may lack as many
    side = np.array([sides[i] for i in order])
    two = bool((side >= 0).any())
    found: list[tuple[int, int]] = []
    clean: dict[int, str] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def form(i: int) -> str:
        if i not in clean:
            clean[i] = plain(plains[order[i]])
        return clean[i]

    for i in range(1, n):
        both = np.bitwise_count(bits[:i] & bits[i]).sum(1, dtype=np.int64) + np.minimum(lost[:i], lost[i])
        near = both * (1 + shared_words) >= shared_words * (sizes[:i] + sizes[i]) - 1e-6
        if two:
            near &= side[:i] != side[i]
        at = np.flatnonzero(near)
        matcher = None
        for j in at.tolist():
            a, b = ids[order[j]], ids[order[i]]
            shared = len(words[i] & words[j])
            if shared / (sizes[i] + sizes[j] - shared) < shared_words - 1e-9 or (parent is not None and root(a) == root(b)):
                continue
            if matcher is None:
                matcher = difflib.SequenceMatcher(None, "", form(i))
            matcher.set_seq1(form(j))
            if form(i) and form(j) and matcher.ratio() >= threshold:
                found.append((a, b))
                if parent is not None:
                    parent[root(b)] = root(a)
    return found


def similar_groups(texts: DataFrame, keys: list[str], plain_text: str, threshold: float) -> DataFrame:
    """``texts`` with ``group``, equal on texts that similar ones link, directly or through others; each distinct row has one."""
    numbered = cut_lineage(texts.withColumn("_id", F.monotonically_increasing_id()))
    linked = connected_components(cut_lineage(similar_pairs(numbered, keys, "_id", plain_text, threshold, links_only=True)), "a", "b")
    return numbered.join(linked.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("group", F.coalesce("component", "_id")).drop("_id", "component")


def agreement(rows: DataFrame, keys: list[str], text: str, weight: str, threshold: float = 0.85) -> DataFrame:
    """``(keys, most_common, consensus_score, n_groups)`` of the texts that models give for one field.

    Texts are first collapsed by their plain form (a partial aggregate), then linked where they are similar; the
    score is the heaviest group's share of all weight, the text the first of its heaviest. Blank and null texts
    take no part; a group of any size is compared by joins on rare words.
    """
    forms = rows.groupBy(*keys, tx.normalised(text).alias("p")).agg(F.min(text).alias("t"), F.sum(weight).alias("w")).where("p is not null and p <> ''")
    groups = similar_groups(forms, keys, "p", threshold).groupBy(*keys, "group").agg(
        F.sum("w").alias("w"), F.min(F.struct((-F.round("w", 10)).alias("o"), F.col("t"))).alias("head")
    )
    best = F.min(F.struct((-F.round("w", 10)).alias("o"), F.col("head.t").alias("t"), F.col("w"))).alias("best")
    out = groups.groupBy(*keys).agg(best, F.sum("w").alias("all"), F.count("*").alias("n_groups"))
    score = F.when(F.col("all") == 0, 0.0).otherwise(F.col("best.w") / F.col("all"))
    return out.select(*keys, F.col("best.t").alias("most_common"), score.alias("consensus_score"), "n_groups")


def distinct_items(rows: DataFrame, keys: list[str], pos: str, text: str, threshold: float = 0.85) -> DataFrame:
    """``(keys, pos)``: of the items of a list that say the same up to similarity, the first; blank and null items are left out."""
    forms = rows.groupBy(*keys, tx.normalised(text).alias("p")).agg(F.min(pos).alias(pos)).where("p is not null and p <> ''")
    return similar_groups(forms, keys, "p", threshold).groupBy(*keys, "group").agg(F.min(pos).alias(pos)).select(*keys, pos)


def merged_sentences(rows: DataFrame, keys: list[str], text: str, weight: str, threshold: float = 0.8, min_agreement: int = 2) -> DataFrame:
    """``(keys, merged)``: sentences that at least two texts share up to similarity, heaviest first; else the heaviest text.

    Sentences are collapsed by their plain form before they are compared. Only the sentences kept for a merged
    text are gathered: they are that text.
    """
    listed = rows.where(F.col(text).isNotNull()).select(*keys, F.col(weight).alias("w"), F.col(text).alias("t"))
    texts = cut_lineage(listed.groupBy(*keys, "t").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
    split = texts.select(*keys, "w", "n", F.explode(tx.sentences("t")).alias("s"))
    forms = split.groupBy(*keys, tx.normalised("s").alias("p")).agg(F.min("s").alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n")).where("p <> ''")
    groups = similar_groups(forms, keys, "p", threshold).groupBy(*keys, "group").agg(
        F.sum("w").alias("w"), F.sum("n").alias("n"), F.min(F.struct((-F.round("w", 10)).alias("o"), F.col("s"))).alias("head")
    )
    kept = groups.where(F.col("n") >= min_agreement).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.round("w", 10)).alias("o"), F.col("head.s").alias("s")))).alias("kept"))
    heaviest = texts.groupBy(*keys).agg(F.min(F.struct((-F.round("w", 10)).alias("o"), "t")).alias("first"))
    joined = F.concat(F.array_join(F.transform("kept", lambda k: k["s"]), ". "), F.lit("."))
    return heaviest.join(kept, keys, "left").select(*keys, F.coalesce(joined, F.col("first.t")).alias("merged"))


def top_keywords(rows: DataFrame, row_id: str, text: str, n: int = 5) -> DataFrame:
    """``(row_id, term, count, rank)``: the most frequent keywords of each text, the first in it on a tie."""
    words = rows.select(row_id, F.posexplode(tx.keywords(text)).alias("pos", "term"))
    counts = words.groupBy(row_id, "term").agg(F.count("*").alias("count"), F.min("pos").alias("pos"))
    best = counts.groupBy(row_id).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "pos", "term", "count"))), 1, n).alias("best"))
    return best.select(row_id, F.posexplode("best").alias("i", "b")).select(row_id, "b.term", "b.count", (F.col("i") + 1).alias("rank"))


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """``(key, text, n)``: one text per plain form, with the number of rows that share it."""
    return cut_lineage(rows.groupBy(tx.normalised(text).alias("key")).agg(F.min(text).alias("text"), F.count("*").alias("n")))
