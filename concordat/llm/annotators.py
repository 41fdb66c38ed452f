"""Consensus of disagreeing annotators by a community confusion model, fitted with variational updates.

Annotators belong to one of a few types. Each type has a confusion matrix per
field, and an annotator's own matrix is drawn around that of its types, so one
with few labels is judged mostly by its type and one with many by its own record.
While the annotators' matrices fit a broadcast of checked size, votes are gathered
once per item and a round is one narrow pass that sends back the annotators' sums;
beyond that a round is two grouped sums over the votes, and what reaches the driver
is one matrix per field and type, whose size no data changes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.labels import spelling_key
from concordat.runtime import BROADCAST_BYTES, broadcast_if_small, cut_lineage

#: Labels of the record schema.
CONTENT_TYPES = ("conceptual_application", "conceptual_theory", "mathematical_derivation", "numerical_calculation")
DIFFICULTIES = tuple(str(n) for n in range(1, 11))


def label_schema(spark: SparkSession, fields: dict[str, Sequence[str]]) -> DataFrame:
    """``(field_name, label_key, label, l, n_classes)`` of every label a field may hold."""
    rows = [(f, s, i, len(labels)) for f, labels in fields.items() for i, s in enumerate(labels)]
    frame = spark.createDataFrame(rows, "field_name string, label string, l int, n_classes int")
    return frame.withColumn("label_key", spelling_key("label"))


def usable_votes(votes: DataFrame, schema: DataFrame, prices: DataFrame) -> DataFrame:
    """``(field_name, question_id, annotator, l)``: distinct usable votes.

    Labels and names count whatever their case and punctuation; a label outside the
    schema, a difficulty that is no whole number from 1 to 10, a null question and
    a nameless annotator give no vote. An annotator missing from the price list
    stands under its own spelling. The same vote delivered again counts once, two
    different votes of one annotator on a question both count.
    """
    fields = [r["field_name"] for r in schema.select("field_name").distinct().collect()]
    names = prices.select(spelling_key("model_name").alias("name_key"), "model_name").dropDuplicates(["name_key"])
    as_text = {f: F.col(f).cast("string") for f in fields}
    long = votes.select(
        "question_id",
        spelling_key("model_name").alias("name_key"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), t.alias("given")) for f, t in as_text.items()])).alias("v"),
    ).select("question_id", "name_key", "v.field_name", spelling_key("v.given").alias("label_key"), "v.given")
    signed = (F.col("field_name") == "difficulty_score") & ~F.col("given").rlike(r"^\s*\d+\s*$")
    kept = long.where(F.col("question_id").isNotNull() & F.col("name_key").isNotNull() & ~F.coalesce(signed, F.lit(False)))
    return (
        kept.join(F.broadcast(schema), ["field_name", "label_key"])  # the labels of the schema: a fixed few
        .join(names, "name_key", "left")
        .select("field_name", "question_id", F.coalesce("model_name", "name_key").alias("annotator"), "l")
        .distinct()
    )


def _digamma(x: np.ndarray) -> np.ndarray:
    """Psi by upward recurrence and the asymptotic series; exact to 1e-10 for x > 0."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1.0 / x
        x += 1.0
    inv = 1.0 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


class _Types:
    """Current beliefs per field about the types: matrices, shares and the shares of the labels."""

    def __init__(self, sizes: dict[str, int], n_types: int, prior: float = 0.5):
        self.sizes, self.n, self.prior = sizes, n_types, prior
        right = np.linspace(0.85, 0.35, n_types)
        self.counts = {}
        for f, c in sizes.items():
            start = np.stack([np.full((c, c), (1 - a) / max(c - 1, 1)) + np.eye(c) * (a - (1 - a) / max(c - 1, 1)) for a in right])
            self.counts[f] = start * 10.0
        self.members = {f: np.ones(n_types) for f in sizes}
        self.labels = {f: np.ones(c) for f, c in sizes.items()}

    def alpha(self, f: str) -> np.ndarray:
        """Dirichlet parameters of the type matrices; the prior leans to the diagonal."""
        c = self.sizes[f]
        return self.counts[f] + self.prior * (np.ones((c, c)) / c + np.eye(c))[None]

    def replace(self, f: str, counts: np.ndarray, members: np.ndarray, labels: np.ndarray) -> float:
        """Take the annotators' sums by type; returns the largest change of a matrix cell."""
        before = self.alpha(f) / self.alpha(f).sum(-1, keepdims=True)
        self.counts[f], self.members[f], self.labels[f] = counts, members, labels + 1.0
        return float(np.abs(self.alpha(f) / self.alpha(f).sum(-1, keepdims=True) - before).max())

    def log_matrices(self, f: str) -> np.ndarray:
        a = self.alpha(f)
        return _digamma(a) - _digamma(a.sum(-1, keepdims=True))


def _own_logs(counts: np.ndarray, types: _Types, f: str, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Type membership, expected log matrix and mean matrix of one annotator with these soft counts."""
    share = types.members[f] + 1.0
    log_share = _digamma(share) - _digamma(share.sum())
    score = log_share + (counts[None] * types.log_matrices(f)).sum((1, 2))
    r = np.exp(score - score.max())
    r /= r.sum()
    a = types.alpha(f)
    centre = np.tensordot(r, a / a.sum(-1, keepdims=True), 1)
    own = counts + strength * centre
    return r, _digamma(own) - _digamma(own.sum(-1, keepdims=True)), own / own.sum(-1, keepdims=True)


def fit_communities(
    votes: DataFrame, sizes: dict[str, int], n_types: int = 3, strength: float = 20.0, rounds: int = 300, tolerance: float = 1e-3, most_shared: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(items, annotators)`` of the fitted model.

    items: field_name, question_id, p (probability of each label), agreement (chance that two of its votes, drawn without
    replacement, are equal; 1 for one vote), n_annotators, n_votes;
    annotators: field_name, annotator, n_votes, reliability (chance to give the true label), type (the likeliest),
    last_change (largest change of a type's matrix in the last round).
    ``votes`` is the result of ``usable_votes``; an empty one gives empty results. Rounds go on until no cell of a
    type's matrix changes by ``tolerance``; where ``rounds`` do not get there, a warning says so. Matrices of
    annotators are sent to the tasks while they take at most ``most_shared`` bytes, with the same result.
    """
    votes = cut_lineage(votes)
    width = max(sizes.values())
    loads = cut_lineage(votes.groupBy("field_name", "annotator").agg(F.count("*").alias("n_votes")))
    n_annotators = loads.count()
    types = _Types(sizes, n_types)
    fit = _fit_shared if n_annotators * 8 * width * width <= most_shared else _fit_joined
    items, annotators, change = fit(votes, loads, n_annotators, types, strength, width, rounds, tolerance)
    if change >= tolerance:
        warnings.warn(f"annotator model still changes by {change:.5f} after {rounds} rounds", stacklevel=2)
    return items, annotators.select("field_name", "annotator", "n_votes", "reliability", "type", F.lit(change).alias("last_change"))


def _fit_shared(
    votes: DataFrame, loads: DataFrame, n_annotators: int, types: _Types, strength: float, width: int, rounds: int, tolerance: float
) -> tuple[DataFrame, DataFrame, float]:
    """The fit over votes gathered per item, of which there are at most as many as labels of all annotators."""
    spark = votes.sparkSession
    people = loads.toPandas().sort_values(["field_name", "annotator"], ignore_index=True)
    people["a"] = np.arange(len(people))
    fields, of = list(types.sizes), people["field_name"].tolist()
    numbered = spark.createDataFrame(people[["field_name", "annotator", "a"]], "field_name string, annotator string, a int")
    place = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, i)])[F.col("field_name")]
    items = cut_lineage(
        votes.join(F.broadcast(numbered), ["field_name", "annotator"])
        .groupBy("field_name", "question_id")
        .agg(F.collect_list("a").alias("a"), F.collect_list("l").alias("l"), F.count("*").alias("n_votes"), F.count_distinct("a").alias("n_annotators"))
        .withColumn("f", place)
    )

    def share(counts: np.ndarray) -> tuple:
        """Log matrices of all annotators and log shares of the labels, for the tasks."""
        logs = np.full((len(of), width, width), 0.0)
        for i, f in enumerate(of):
            c = types.sizes[f]
            logs[i, :c, :c] = _own_logs(counts[i, :c, :c], types, f, strength)[1]
        prior = np.full((len(fields), width), -np.inf)
        for i, f in enumerate(fields):
            prior[i, : types.sizes[f]] = np.log(types.labels[f] / types.labels[f].sum())
        return spark.sparkContext.broadcast((logs, prior))

    def posterior(batch: pa.RecordBatch, logs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, ...]:
        """Label probabilities of a batch's items and, vote by vote, its item, annotator and label."""
        at, f = batch.schema.names, batch.column("f").to_numpy(zero_copy_only=False)
        a, given = (batch.column(at.index(c)).flatten().to_numpy(zero_copy_only=False) for c in ("a", "l"))
        sizes = np.diff(batch.column("a").offsets.to_numpy())
        item = np.repeat(np.arange(len(f)), sizes)
        score = np.add.reduceat(logs[a, :, given], np.cumsum(sizes) - sizes) + prior[f]
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), item, a, given

    def one_round(shared) -> np.ndarray:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logs, prior = shared.value
            total = np.zeros((len(logs), width, width))  # the checked size
            for batch in batches:
                if len(batch):
                    p, item, a, given = posterior(batch, logs, prior)
                    np.add.at(total.transpose(0, 2, 1), (a, given), p[item])
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "v"])

        sums = items.select("f", "a", "l").mapInArrow(step, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(len(of) * width * width)
        out[sums["cell"]] = sums["v"]
        return out.reshape(len(of), width, width)

    counts, change, shared = np.zeros((len(of), width, width)), 0.0, share(np.zeros((len(of), width, width)))
    for turn in range(rounds if of else 0):
        counts = one_round(shared)
        shared.unpersist()
        change = _settle(counts, of, types, strength)
        shared = share(counts)
        if change < tolerance and turn > 2:
            break

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = shared.value
        for batch in batches:
            if len(batch):
                p, item, _, given = posterior(batch, logs, prior)
                known = prior > -np.inf
                lists = pa.array([row[k].tolist() for row, k in zip(p, known[batch.column("f").to_numpy(zero_copy_only=False)], strict=True)], pa.list_(pa.float64()))
                alike = np.zeros((len(p), width))
                np.add.at(alike, (item, given), 1)
                n = alike.sum(1)
                agreement = np.where(n > 1, (alike * (alike - 1)).sum(1) / np.maximum(n * (n - 1), 1), 1.0)
                keep = [batch.column(c) for c in ("field_name", "question_id")]
                yield pa.RecordBatch.from_arrays([*keep, lists, pa.array(agreement), batch.column("n_annotators"), batch.column("n_votes")], _ITEM)

    out = items.mapInArrow(label, "field_name string, question_id string, p array<double>, agreement double, n_annotators long, n_votes long")
    own = [_own_logs(counts[i, : types.sizes[f], : types.sizes[f]], types, f, strength) for i, f in enumerate(of)]
    people["reliability"] = [float((types.labels[f] / types.labels[f].sum() * np.diag(mean)).sum()) for f, (_, _, mean) in zip(of, own, strict=True)]
    people["type"] = [int(r.argmax()) for r, _, _ in own]
    known = spark.createDataFrame(people.drop(columns="a"), "field_name string, annotator string, n_votes long, reliability double, type int")
    return out, known, change


_ITEM = ["field_name", "question_id", "p", "agreement", "n_annotators", "n_votes"]


def _settle(counts: np.ndarray, of: list[str], types: _Types, strength: float) -> float:
    """New type matrices from all annotators' counts; returns the largest change of a matrix cell."""
    sums: dict[str, list] = {}
    for n, f in zip(counts, of, strict=True):
        c = types.sizes[f]
        n = n[:c, :c]
        r = _own_logs(n, types, f, strength)[0]
        a, b, d = sums.get(f, (0.0, 0.0, 0.0))
        sums[f] = (a + r[:, None, None] * n[None], b + r, d + n.sum(1))
    return max((types.replace(f, *s) for f, s in sums.items()), default=0.0)


def _fit_joined(
    votes: DataFrame, loads: DataFrame, n_annotators: int, types: _Types, strength: float, width: int, rounds: int, tolerance: float
) -> tuple[DataFrame, DataFrame, float]:
    """The fit for any number of annotators: votes meet their annotator's matrix and their item's labels by joins."""
    counts, change = None, 0.0
    n, alike = F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1))
    votes_of = votes.groupBy("field_name", "question_id", "l").agg(F.count("*").alias("c")).groupBy("field_name", "question_id").agg(
        F.when(n < 2, 1.0).otherwise(alike / F.greatest(n * (n - 1), F.lit(1))).alias("agreement")
    )
    people = votes.groupBy("field_name", "question_id").agg(F.count("*").alias("n_votes"), F.count_distinct("annotator").alias("n_annotators"))
    people = cut_lineage(people.join(votes_of, ["field_name", "question_id"]))
    for turn in range(rounds):
        params = loads if counts is None else counts
        soft = _posteriors(votes, _annotator_table(params, types, strength, counts is None), types, n_annotators, width)
        counts = cut_lineage(_soft_counts(votes, soft, width))
        change = _update_types(counts, types, strength)
        if change < tolerance and turn > 2:
            break
    matrices = _annotator_table(counts, types, strength, False) if counts is not None else _annotator_table(loads, types, strength, True)
    items = _posteriors(votes, matrices, types, n_annotators, width).join(people, ["field_name", "question_id"])
    reliability = matrices.select("field_name", "annotator", "type", "reliability").join(loads, ["field_name", "annotator"])
    return items.select(*_ITEM), reliability, change


def _annotator_table(params: DataFrame, types: _Types, strength: float, fresh: bool) -> DataFrame:
    """Per annotator the expected log matrix (row by row), the likeliest type and the reliability."""
    columns = ["field_name", "annotator"] + ([] if fresh else ["counts"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logs, best, right = [], [], []
            for row in batch.itertuples(index=False):
                f, c = row.field_name, types.sizes[row.field_name]
                n = np.zeros((c, c)) if fresh else np.asarray(row.counts, float).reshape(-1, int(len(row.counts) ** 0.5))[:c, :c]
                r, log, mean = _own_logs(n, types, f, strength)
                share = types.labels[f] / types.labels[f].sum()
                logs.append(log.ravel().tolist())
                best.append(int(r.argmax()))
                right.append(float((share * np.diag(mean)).sum()))
            yield pd.DataFrame({"field_name": batch["field_name"], "annotator": batch["annotator"], "logs": logs, "type": best, "reliability": right})

    return params.select(*columns).mapInPandas(solve, "field_name string, annotator string, logs array<double>, type int, reliability double")


def _posteriors(votes: DataFrame, annotators: DataFrame, types: _Types, n_annotators: int, width: int) -> DataFrame:
    """Label probabilities of every item: one grouped sum of log likelihoods."""
    logs = annotators.select("field_name", "annotator", "logs")
    joined = votes.join(broadcast_if_small(logs, n_annotators, 8 * width * width), ["field_name", "annotator"])
    n_classes = F.create_map(*[F.lit(x) for f, c in types.sizes.items() for x in (f, c)])[F.col("field_name")]
    likelihood = [F.sum(F.coalesce(F.get("logs", F.lit(c) * n_classes + F.col("l")), F.lit(0.0))).alias(f"s{c}") for c in range(width)]
    summed = joined.groupBy("field_name", "question_id").agg(*likelihood)
    prior = {f: np.log(v / v.sum()).tolist() for f, v in types.labels.items()}
    start = F.create_map(*[x for f, p in prior.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in p]))])[F.col("field_name")]
    scores = F.transform(
        F.slice(F.array(*[F.col(f"s{c}") for c in range(width)]), 1, n_classes), lambda s, i: s + F.get(start, i)
    )
    weights = F.transform("scores", lambda s: F.exp(s - F.array_max("scores")))
    p = F.transform("weights", lambda w: w / F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    return (
        summed.withColumn("scores", scores).withColumn("weights", weights)
        .select("field_name", "question_id", p.alias("p"))
    )


def _soft_counts(votes: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Per annotator the expected counts of (true label, given label), as one padded matrix."""
    joined = votes.join(items.select("field_name", "question_id", "p"), ["field_name", "question_id"])
    sums = joined.groupBy("field_name", "annotator", "l").agg(*[F.sum(F.coalesce(F.get("p", F.lit(c)), F.lit(0.0))).alias(f"n{c}") for c in range(width)])
    cells = [
        F.coalesce(F.sum(F.when(F.col("l") == given, F.col(f"n{true}"))), F.lit(0.0)) for true in range(width) for given in range(width)
    ]
    return sums.groupBy("field_name", "annotator").agg(F.array(*cells).alias("counts"))


def _update_types(counts: DataFrame, types: _Types, strength: float) -> float:
    """New type matrices from the annotators' counts; returns the largest change of a matrix cell."""

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                f, c = row.field_name, types.sizes[row.field_name]
                n = np.asarray(row.counts, float).reshape(-1, int(len(row.counts) ** 0.5))[:c, :c]
                r, _, _ = _own_logs(n, types, f, strength)
                a, b, d = total.get(f, (0.0, 0.0, 0.0))
                total[f] = (a + r[:, None, None] * n[None], b + r, d + n.sum(1))
        for f, (a, b, d) in total.items():
            yield pd.DataFrame({"field_name": [f], "n": [a.ravel().tolist()], "m": [b.tolist()], "k": [d.tolist()]})

    # one row of fixed size per field and task, summed again before it reaches the driver
    parts = counts.mapInPandas(weigh, "field_name string, n array<double>, m array<double>, k array<double>")
    flat = parts.select("field_name", F.posexplode(F.concat("n", "m", "k")).alias("i", "v")).groupBy("field_name", "i").agg(F.sum("v").alias("v"))
    change = 0.0
    for f, cells in flat.toPandas().groupby("field_name"):
        c, k = types.sizes[f], types.n
        v = cells.sort_values("i")["v"].to_numpy()
        change = max(change, types.replace(f, v[: k * c * c].reshape(k, c, c), v[k * c * c : k * c * c + k], v[-c:]))
    return change


def consensus(items: DataFrame, schema: DataFrame, min_annotators: int = 3) -> DataFrame:
    """``(question_id, field_name, label, confidence, agreement, n_annotators)`` of items with enough annotators.

    The label is the likeliest one, the first of the schema on a tie.
    """
    top = items.where(F.col("n_annotators") >= min_annotators).withColumn("confidence", F.array_max("p"))
    named = top.withColumn("l", (F.array_position("p", F.col("confidence")) - 1).cast("int")).join(
        F.broadcast(schema.select("field_name", "l", "label")), ["field_name", "l"]
    )
    return named.select("question_id", "field_name", "label", "confidence", "agreement", "n_annotators")
