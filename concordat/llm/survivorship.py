"""One surviving record per group of duplicates, built from consistent bundles of fields.

Fields that depend on each other form a bundle and are taken from one row
together. Each bundle alone would take its most trusted row; where such a choice
breaks a dependency between two bundles, branch and bound searches the group's
combinations for the most trusted one that keeps every dependency. The bound is
the free choice of the bundles still open, so groups whose free choice is already
consistent (nearly all) are settled by one grouped maximum and never branch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.labels import spelling_key
from concordat.operators.components import connected_components
from concordat.runtime import cut_lineage, is_empty


@dataclass(frozen=True)
class Bundle:
    """Fields taken together from one row; a row may give the bundle only where ``usable`` holds."""

    name: str
    fields: tuple[str, ...]
    usable: Column


@dataclass(frozen=True)
class Dependency:
    """The kept ``left_field`` of one bundle must equal the kept ``right_field`` of another; null agrees with all."""

    left: str
    left_field: str
    right: str
    right_field: str


@dataclass(frozen=True)
class Trust:
    """Which row deserves a bundle: lowest ``order``, then latest ``recency`` (null oldest), then smallest ``row_id``."""

    order: str
    recency: str
    row_id: str
    worst: int = field(default=1 << 30)

    def key(self) -> Column:
        """Struct whose minimum is the most trusted row."""
        late = F.coalesce(-F.unix_micros(F.col(self.recency)), F.lit((1 << 63) - 1))
        return F.struct(
            F.coalesce(F.col(self.order).cast("int"), F.lit(self.worst)).alias("o"), late.alias("t"), F.col(self.row_id).cast("long").alias("id")
        )


#: Columns that these operators add; columns of that name in the input are dropped.
_OWN = ("call", "trust_order", "canonical_model", "component", "_r", "_g", "_key", "_first")


def same_call(responses: DataFrame) -> DataFrame:
    """``responses`` with ``call``, equal on rows that report one model call, directly or through other rows.

    Rows belong together if they have the same request_id apart from letter case
    and blanks around it, or the same question_id and generated_at. A null or blank
    request_id and a null question_id or generated_at join nothing. Only the few
    pairs of keys that such a request_id ties together enter the component search.
    """
    responses = responses.drop(*_OWN)
    rid = F.nullif(F.lower(F.btrim("request_id", F.lit(" \t\r\n"))), F.lit(""))
    keyed = responses.withColumn("_r", F.when(rid.isNotNull(), F.concat(F.lit("r"), rid))).withColumn(
        "_g",
        F.when(
            F.col("question_id").isNotNull() & F.col("generated_at").isNotNull(),
            F.concat_ws("|", F.lit("g"), F.unix_micros("generated_at").cast("string"), F.col("question_id")),
        ),
    )
    # a request_id over several moments ties these moments to its first one
    pairs = keyed.where("_r is not null and _g is not null").groupBy("_r", "_g").agg(F.lit(1).alias("one"))
    moments = pairs.groupBy("_r").agg(F.min("_g").alias("_first"))
    spread = pairs.groupBy("_r").agg(F.min("_g").alias("_first"), F.count("*").alias("n")).where("n > 1")
    ties = pairs.join(spread, "_r").where("_first <> _g").select(F.col("_g").alias("src"), F.col("_first").alias("dst"))
    ties = cut_lineage(ties.distinct())
    # rows without a moment stand by their request_id; they join its first moment where it has one
    lone = keyed.where("_g is null").join(moments, "_r", "left").withColumn("_g", F.coalesce("_first", "_r")).drop("_first")
    unnamed = F.concat(F.lit("u"), F.col("response_id").cast("string"))
    placed = keyed.where("_g is not null").unionByName(lone.select(keyed.columns)).withColumn("_g", F.coalesce("_g", unnamed))
    if is_empty(ties):
        return placed.withColumn("call", F.col("_g")).drop("_r", "_g")
    roots = connected_components(ties).withColumnRenamed("node", "_g")
    return placed.join(roots, "_g", "left").withColumn("call", F.coalesce("component", "_g")).drop("_r", "_g", "component")


def best_representatives(
    rows: DataFrame, group: str, bundles: Sequence[Bundle], trust: Trust, dependencies: Sequence[Dependency] = ()
) -> DataFrame:
    """``(group, n_rows, first_id, kept)``: kept maps each bundle's name to the row id it is taken from.

    ``rows`` has one row per record with ``group``, the trust columns and all
    fields. A bundle with no usable row is missing from ``kept``; ties of trust go
    to the smallest row id; a null group is no group and is left out. Where no
    combination keeps all dependencies, the least trusted bundles give up their
    value until the rest agrees. A group's candidates are reduced to the most
    trusted row per bundle and dependency value, so a huge group costs one
    partial aggregate per bundle and only its distinct values are compared.
    """
    links = {b.name: [] for b in bundles}
    for d in dependencies:
        links[d.left].append(d.left_field)
        links[d.right].append(d.right_field)
    key = trust.key()
    # the root of the search: every bundle's free choice, with its dependency values
    free = [
        F.min(F.when(b.usable, F.struct(key.alias("k"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(links[b.name])]))).alias(f"b{n}")
        for n, b in enumerate(bundles)
    ]
    root = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"), F.min(trust.row_id).alias("first_id"), *free)
    at = {b.name: n for n, b in enumerate(bundles)}
    broken = F.lit(False)
    sides = []
    used: dict[str, int] = {b.name: 0 for b in bundles}
    for d in dependencies:
        left, right = (d.left, used[d.left]), (d.right, used[d.right])
        used[d.left] += 1
        used[d.right] += 1
        sides.append((at[left[0]], left[1], at[right[0]], right[1]))
        a, b = F.col(f"b{at[left[0]]}.v{left[1]}"), F.col(f"b{at[right[0]]}.v{right[1]}")
        broken = broken | F.coalesce(a != b, F.lit(False))

    def kept(choice: list[Column]) -> Column:
        pairs = [F.struct(F.lit(b.name).alias("bundle"), c.alias("row_id")) for b, c in zip(bundles, choice, strict=True)]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["row_id"].isNotNull()))

    root = cut_lineage(root) if dependencies else root
    settled = root.select(group, "n_rows", "first_id", kept([F.col(f"b{n}.k.id") for n in range(len(bundles))]).alias("kept"), broken.alias("_broken"))
    if not dependencies:
        return settled.drop("_broken")
    open_groups = settled.where("_broken").select(group)

    def candidate(n: int, b: Bundle) -> Column:
        values = F.array(*[F.col(f).cast("string") for f in links[b.name]]).cast("array<string>")
        return F.when(b.usable, F.struct(F.lit(n).alias("n"), key.alias("k"), values.alias("v")))

    offered = F.filter(F.array(*[candidate(n, b) for n, b in enumerate(bundles)]), lambda c: c.isNotNull())
    each = rows.join(open_groups, group, "left_semi").select(group, F.explode(offered).alias("c")).select(group, "c.n", "c.k", "c.v")
    per_value = each.groupBy(group, "n", "v").agg(F.min("k").alias("k"))
    pool = per_value.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("n", "k", "v"))).alias("pool"))
    kind, n_bundles = rows.schema[group].dataType.simpleString(), len(bundles)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picks = [branch_and_bound([[c for c in pool if c["n"] == n] for n in range(n_bundles)], sides) for pool in batch["pool"]]
            yield pd.DataFrame({group: batch[group], "ids": picks})

    chosen = pool.mapInPandas(search, f"`{group}` {kind}, ids array<bigint>")
    branched = (
        root.join(chosen, group).select(group, "n_rows", "first_id", kept([F.element_at("ids", n + 1) for n in range(len(bundles))]).alias("kept"))
    )
    return settled.where("not _broken").drop("_broken").unionByName(branched)


def branch_and_bound(options: list[list], sides: list[tuple[int, int, int, int]]) -> list:
    """Row id per bundle (None: given up) of the most trusted combination that keeps all dependencies.

    ``options`` holds each bundle's candidates, best first. Combinations are
    compared by the fewest bundles given up, then the sum of trust orders, then of
    ages, then of row ids. A branch ends where its bound, the free choice of all
    open bundles, is no better than the best found.
    """
    none = (1, 0, 0, 0)
    cost = lambda c: (0, c["k"]["o"], c["k"]["t"], c["k"]["id"])
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    ordered = [sorted(o, key=cost) for o in options]
    rest = [(0, 0, 0, 0)]
    for o in reversed(ordered):
        rest.append(add(rest[-1], cost(o[0]) if o else none))
    rest.reverse()
    best: list = [None, [None] * len(options)]

    def agrees(picked: list, n: int, c) -> bool:
        for ln, lv, rn, rv in sides:
            if n in (ln, rn) and max(ln, rn) == n:
                other, mine, theirs = (rn, lv, rv) if n == ln else (ln, rv, lv)
                peer = c if other == n else picked[other]
                if peer is not None and c["v"][mine] is not None and peer["v"][theirs] is not None and c["v"][mine] != peer["v"][theirs]:
                    return False
        return True

    def branch(n: int, picked: list, spent: tuple) -> None:
        if best[0] is not None and add(spent, rest[n]) >= best[0]:
            return
        if n == len(ordered):
            best[0], best[1] = spent, [None if c is None else int(c["k"]["id"]) for c in picked]
            return
        for c in ordered[n]:
            if agrees(picked, n, c):
                branch(n + 1, [*picked, c], add(spent, cost(c)))
        branch(n + 1, [*picked, None], add(spent, none))

    branch(0, [], (0, 0, 0, 0))
    return best[1]


def response_bundles(known_model: Column) -> list[Bundle]:
    """The three fields that deliveries of one call disagree on; none depends on another."""
    unit = lambda c: F.col(c).between(0.0, 1.0) & ~F.isnan(c)
    return [
        Bundle("confidence", ("confidence",), unit("confidence")),
        Bundle("classification_confidence", ("classification_confidence",), unit("classification_confidence")),
        Bundle("model_name", ("model_name",), known_model),
    ]


def trusted_calls(responses: DataFrame, channels: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows of ``responses`` with their ``call``, ``trust_order`` and ``canonical_model`` (null where unusable).

    ``channels`` and ``prices`` are fixed dimension tables of a few rows; the
    larger of two rows for one channel or spelling is ignored.
    """
    order = channels.groupBy("channel").agg(F.min("trust_order").alias("trust_order"))
    names = prices.where("model_name is not null").groupBy(spelling_key("model_name").alias("_key")).agg(F.min("model_name").alias("canonical_model"))
    return (
        same_call(responses)
        .join(order, "channel", "left")
        .withColumn("_key", spelling_key("model_name"))
        .join(names, "_key", "left")
        .drop("_key")
    )
