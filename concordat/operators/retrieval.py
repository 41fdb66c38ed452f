"""Keyword search, vector search, fusion of both and the semantic cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.runtime import BROADCAST_BYTES, broadcast_if_small, cut_lineage

K1, B, RRF_K = 1.5, 0.75, 60


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per query with their ``rank``; scores equal to eight places go by ``tie``."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 8)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_frequencies(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, term, tf)`` of all keywords."""
    return documents.select(doc_id, F.explode(tx.keywords(text)).alias("term")).groupBy(doc_id, "term").agg(F.count("*").alias("tf"))


def document_lengths(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, dl)``; a document without a keyword has length 0 and counts for the average."""
    return documents.select(doc_id, F.size(tx.keywords(text)).alias("dl"))


def corpus_stats(lengths: DataFrame, doc_id: str) -> DataFrame:
    """One row: number of documents and their average length."""
    return lengths.agg(F.count_distinct(doc_id).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(queries: DataFrame, documents: DataFrame, query_id: str, query_text: str, doc_id: str, text: str) -> DataFrame:
    """``(query_id, doc_id, score)`` of every document that shares a keyword with the query; a query's words count once.

    Texts are split once. Of a document only its length and its uses of asked words go on: the asked words, whose
    size is checked, meet the exploded words before anything is shuffled. Rows of one doc_id are one document;
    a null doc_id is none, null texts have length 0 and count for the average.
    """
    asked = cut_lineage(queries.select(query_id, F.explode(F.array_distinct(tx.keywords(query_text))).alias("term")))
    wanted = asked.select(F.col("term").alias("asked")).distinct()
    wanted = broadcast_if_small(wanted, wanted.count(), 64)
    # the words are worked out once: what is exploded is not repeated wherever it is used
    split = documents.where(F.col(doc_id).isNotNull()).select(doc_id, F.explode(F.array(tx.keywords(text))).alias("words"))
    uses = split.select(doc_id, F.size("words").alias("dl"), F.posexplode_outer("words").alias("pos", "word")).join(wanted, F.col("word") == F.col("asked"), "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    kept = uses.where(first | F.col("asked").isNotNull()).select(doc_id, "asked", F.when(first, F.col("dl")).otherwise(0).alias("dl"))
    per_term = kept.groupBy(doc_id, "asked").agg(F.count("asked").alias("tf"), F.sum("dl").alias("dl"))
    terms = F.collect_list(F.when(F.col("asked").isNotNull(), F.struct(F.col("asked").alias("term"), "tf")))
    docs = cut_lineage(per_term.groupBy(doc_id).agg(F.sum("dl").alias("dl"), terms.alias("terms")))
    size = docs.agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    n = float(size["n"])
    avgdl = float(size["s"] or 0) / (n or 1.0) or 1.0
    hits = docs.select(doc_id, "dl", F.inline("terms"))
    df = cut_lineage(hits.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    asked = asked.join(broadcast_if_small(df, df.count(), 64), "term")
    return hits.join(broadcast_if_small(asked, asked.count(), 96), "term").groupBy(query_id, doc_id).agg(F.sum(weight).alias("score")).where("score > 0")


def bm25_best(
    queries: DataFrame, documents: DataFrame, query_id: str, query_text: str, doc_id: str, text: str, k: int, marked: Column | None = None, most_shared: int = BROADCAST_BYTES
) -> DataFrame:
    """``(query_id, doc_id, score, marked, rank)``: the k best documents of each query by the scores of ``bm25``.

    With ``marked`` there is a second list of each query: the k best of the documents for which it holds.
    Nearly every document shares a word with nearly every query, so scores are never rows: the queries' words are
    sent to the tasks, which add up the scores of a chunk of documents at a time and keep the k best of each query.
    Queries of the same words are scored once; if their words take more than ``most_shared`` bytes they are cut into
    blocks of that size, and the documents are read once per block. doc_id must be a whole number; queries without
    an id are one query.
    """
    worded = queries.groupBy(query_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tx.keywords(query_text))))).alias("words"))
    worded = cut_lineage(worded.where(F.size("words") > 0))
    sets = cut_lineage(worded.select("words").distinct().withColumn("set", F.monotonically_increasing_id()))
    lists = 1 if marked is None else 2
    blocks = max(1, _blocks(sets, most_shared), -(-sets.count() * k * lists * 16 // (4 * most_shared)))  # the best of a block are held by every task
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.lit(False) if marked is None else marked, F.lit(False)).alias("marked"), tx.keywords(text).alias("words"))
    found = None
    for block in range(blocks):
        part = sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("set"), F.lit(blocks)) == block)
        best = _best_of_words(part, rows, k, marked is not None)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("set", "marked").orderBy(F.desc(F.round("score", 8)), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asking = worded.join(sets, "words").select(query_id, "set")
    return ranked.join(asking, "set").select(query_id, F.col("id").cast(documents.schema[doc_id].dataType).alias(doc_id), "score", "marked", "rank")


def _blocks(sets: DataFrame, most_shared: int) -> int:
    """How many blocks the sets take: each word is sent once and a code for each of its uses; where the words alone fill a block, all uses count as words."""
    size = sets.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 8 * F.size("words")).alias("words"), F.sum(4 * F.size("words") + 16).alias("codes")).first()
    once = sets.select(F.explode("words").alias("word")).distinct().agg(F.sum(F.octet_length("word") + 8).alias("bytes")).first()["bytes"] or 0
    return -(-(size["words"] or 0) // most_shared) if once > most_shared // 2 else -(-(size["codes"] or 0) // (most_shared - once))


def _best_of_words(sets: DataFrame, rows: DataFrame, k: int, with_marked: bool) -> DataFrame:
    """``(set, id, marked, score)``: the k best documents of every task for each set of words of a block."""
    context = sets.sparkSession.sparkContext
    block = sets.select("set", "words").orderBy("set").toArrow().combine_chunks()
    words = block.column("words").combine_chunks()
    names = np.asarray(block.column("set").to_numpy())
    flat = words.flatten()
    vocabulary = pc.unique(flat)
    of_set = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    shared_words = context.broadcast(vocabulary.to_pylist())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared_words.value, pa.string())
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(batch.column(2).flatten().cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            kept = np.bincount(np.repeat(np.arange(len(batch)), sizes)[code >= 0], minlength=len(batch))
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(code[code >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), codes], ["id", "marked", "dl", "codes"])

    docs = rows.mapInArrow(coded, "id long, marked boolean, dl long, codes array<int>")
    parts = docs.rdd.getNumPartitions()
    if parts < context.defaultParallelism:
        docs = docs.repartition(context.defaultParallelism, "id")
    elif parts > context.defaultParallelism:  # every task gives k rows of each query
        docs = docs.coalesce(context.defaultParallelism)
    docs = cut_lineage(docs)
    size = docs.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("n"), F.sum("dl").alias("s")).first()
    if size["rows"] != size["n"]:  # rows of one id are one document
        docs = cut_lineage(docs.groupBy("id").agg(F.max("marked").alias("marked"), F.sum("dl").alias("dl"), F.flatten(F.collect_list("codes")).alias("codes")))
    n = size["n"]
    avgdl = (size["s"] or 0) / (n or 1) or 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared_words.value), np.int64)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(batch), dtype=np.int64), sizes) * len(held) + batch.column(0).flatten().to_numpy()
            held += np.bincount(np.unique(at) % max(len(held), 1), minlength=len(held))
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["code", "n"])

    df = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        df[r["code"]] = r["n"]
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
    most = int(np.diff(ends).max(initial=0))
    kind, limit = (np.uint16, (1 << 16) - 1) if most <= 256 else (np.uint32, (1 << 32) - 1)
    highest = np.bincount(np.repeat(np.arange(len(names)), np.diff(ends)), np.where(df > 0, idf, 0.0)[of_set] * (K1 + 1), len(names)).max(initial=0.0)
    unit = float(highest) / (limit - most) or 1.0  # no query's units exceed the limit, each word's being rounded up
    shared = context.broadcast((names, ends, of_set, idf, unit, kind))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends, of_set, idf, unit, kind = shared.value
        kept = [_Best(len(names), k, unit) for _ in range(1 + with_marked)]
        for ids, marked, dl, row, code in _chunks(batches):
            scores = _Scores(len(ids), dl / avgdl, row, code, idf, unit, kind)
            places = [None, np.flatnonzero(marked)][: len(kept)]
            waiting: list[list] = [[] for _ in kept]
            some = 0
            for q in range(len(names)):
                codes = of_set[ends[q] : ends[q + 1]]
                units = scores.units_of(codes)
                for b, at, near in zip(kept, places, waiting, strict=True):
                    there = b.near(q, units if at is None else units[at], len(codes))
                    if len(there):
                        near.append((q, there if at is None else at[there]))
                        some += len(there) * len(codes)
                if some > 1 << 20 or q == len(names) - 1:
                    for b, near in zip(kept, waiting, strict=True):
                        if near:
                            asking = np.repeat([x for x, _ in near], [len(there) for _, there in near])
                            there = np.concatenate([there for _, there in near])
                            b.add(asking, ids[there], scores.of(of_set, ends, asking, there))
                            near.clear()
                    some = 0
        for flag, b in enumerate(kept):
            for q, ids, score in b.rows():
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids), pa.array(np.full(len(ids), bool(flag))), pa.array(score)], ["set", "id", "marked", "score"])

    return docs.mapInArrow(best, "set long, id long, marked boolean, score double")


def _chunks(batches: Iterator[pa.RecordBatch], most_rows: int = 16384, most_words: int = 2 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """``(ids, marked, dl, row, code)`` of some thousand documents at a time; row tells whose code each is."""
    waiting: list[pa.RecordBatch] = []
    rows = words = 0

    def joined() -> tuple[np.ndarray, ...]:
        columns = [pa.concat_arrays([b.column(i) for b in waiting]) for i in range(4)]
        ids, marked, dl = (c.to_numpy(zero_copy_only=False) for c in columns[:3])
        sizes = pc.list_value_length(columns[3]).to_numpy(zero_copy_only=False)
        return ids, marked.astype(bool), dl, np.repeat(np.arange(len(ids)), sizes), columns[3].flatten().to_numpy().astype(np.int64)

    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            more = len(part.column(3).flatten())
            if waiting and (rows + len(part) > most_rows or words + more > most_words):
                yield joined()
                waiting, rows, words = [], 0, 0
            waiting.append(part)
            rows, words = rows + len(part), words + more
    if waiting:
        yield joined()


class _Scores:
    """The documents of a chunk by word: a line of weights for words of many documents, else places and weights.

    Weights are also held rounded up to whole units, whose sums are quick and never below the scores: only
    documents whose units reach a query's least score are scored in full.
    """

    def __init__(self, n: int, length: np.ndarray, row: np.ndarray, code: np.ndarray, idf: np.ndarray, unit: float, kind: type):
        self.pair, tf = np.unique(code * n + row, return_counts=True)
        code, self.row = np.divmod(self.pair, n)
        self.n, self.weight = n, idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.row]))
        self.units, self.total = np.ceil(self.weight / unit).astype(kind), np.zeros(n, kind)
        self.at = np.searchsorted(code, np.arange(len(idf) + 1)).tolist()
        many = np.flatnonzero(np.diff(self.at) > n // 16)
        self.line = np.full(len(idf), -1)
        self.line[many] = np.arange(len(many))
        self.exact = np.zeros((len(many), n))
        self.dense = {}
        for i, c in enumerate(many.tolist()):
            held = slice(self.at[c], self.at[c + 1])
            self.exact[i, self.row[held]] = self.weight[held]
            self.dense[c] = line = np.zeros(n, kind)
            line[self.row[held]] = self.units[held]

    def units_of(self, codes: np.ndarray) -> np.ndarray:
        """Units of every document for one query's words; the array is used again."""
        total = self.total
        total.fill(0)
        for c in codes.tolist():
            line = self.dense.get(c)
            if line is not None:
                np.add(total, line, total)
            elif self.at[c] < self.at[c + 1]:
                held = slice(self.at[c], self.at[c + 1])
                total[self.row[held]] += self.units[held]
        return total

    def of(self, of_set: np.ndarray, ends: np.ndarray, query: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The full score of each pair of a query and a document's place."""
        sizes = ends[query + 1] - ends[query]
        pair = np.repeat(np.arange(len(query)), sizes)
        code = of_set[np.arange(len(pair)) + np.repeat(ends[query] - np.cumsum(sizes) + sizes, sizes)].astype(np.int64)
        row, line, weight = place[pair], self.line[code], np.zeros(len(pair))
        there = line >= 0
        weight[there] = self.exact[line[there], row[there]]
        rare = np.flatnonzero(~there)
        if len(rare) and len(self.pair):
            key = code[rare] * self.n + row[rare]
            found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            weight[rare] = np.where(self.pair[found] == key, self.weight[found], 0.0)
        return np.bincount(pair, weight, len(query))


class _Best:
    """The k best documents so far of each query; scores equal to eight places go by the smaller id."""

    def __init__(self, n: int, k: int, unit: float):
        self.k, self.unit = k, unit
        self.ids, self.scores = np.zeros((n, k), np.int64), np.zeros((n, k))
        self.need = np.ones(n, np.int64)

    def near(self, q: int, units: np.ndarray, words: int) -> np.ndarray:
        """Places that may be among the best: units exceed a score by less than one for each word."""
        there = (units >= self.need.item(q)).nonzero()[0]
        if len(there) > 4 * self.k:
            some = units[there]
            there = there[some >= max(int(np.partition(some, -self.k)[-self.k]) - words - 2, 1)]
        return there

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        old = np.unique(query)
        at, place = np.nonzero(self.scores[old] > 0)
        query, ids, score = (np.concatenate(x) for x in ((old[at], query), (self.ids[old[at], place], ids), (self.scores[old[at], place], score)))
        order = np.lexsort((ids, -np.round(score, 8), query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = (place < self.k) & (score > 0)
        self.ids[query[top], place[top]], self.scores[query[top], place[top]] = ids[top], score[top]
        full = top & (place == self.k - 1)
        self.need[query[full]] = np.maximum(np.floor((score[full] - 2e-8) / self.unit).astype(np.int64) - 1, 1)

    def rows(self, some: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(self.scores), some):
            at, place = np.nonzero(self.scores[start : start + some] > 0)
            yield at + start, self.ids[at + start, place], self.scores[at + start, place]


def fuse(dense: DataFrame, sparse: DataFrame, query_id: str, doc_id: str, k: int = 6) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: ``(query_id, doc_id, dense_rank, sparse_rank, hybrid_score, source, relevance, rank)``."""
    both = dense.select(query_id, doc_id, F.col("rank").alias("dense_rank")).join(
        sparse.select(query_id, doc_id, F.col("rank").alias("sparse_rank")), [query_id, doc_id], "full_outer"
    )
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    source = F.when(F.col("sparse_rank").isNull(), "dense_only").when(F.col("dense_rank").isNull(), "sparse_only").otherwise("both")
    scored = both.withColumn("hybrid_score", part("dense_rank") + part("sparse_rank")).withColumn("source", source)
    return top_k(scored.withColumn("relevance", F.least(F.col("hybrid_score") * 30, F.lit(1.0))), query_id, "hybrid_score", doc_id, k)


def nearest(queries: DataFrame, corpus: DataFrame, vec_id: str, vector: str, k: int, threshold: float = -2.0, most_shared: int = BROADCAST_BYTES) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the k most similar vectors of each query by cosine, itself left out.

    A stated query set against all rows. While the queries take at most ``most_shared`` bytes they are sent to the
    tasks, which read the corpus once and keep the k best of each query; more queries are cut into blocks of that
    size, and the corpus is read once per block. A vector without length has similarity 0, a null vector or id is
    left out; scores equal to eight places go by the smaller id. All vectors must have one length.
    """
    there = lambda frame: frame.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked, rows = there(queries).dropDuplicates(["id"]), there(corpus)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    blocks = max(1, -(-(size["n"] * ((size["dim"] or 0) + 1) * 8) // most_shared))
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        best = _nearest_of(part, rows, vec_id, k, threshold)
        found = best if found is None else found.unionByName(best)
    return top_k(found, "query_id", "score", vec_id, k)


def _units(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return ids.to_numpy(zero_copy_only=False), np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _nearest_of(asked: DataFrame, rows: DataFrame, vec_id: str, k: int, threshold: float) -> DataFrame:
    """The k best of every task for each query of a block whose size is checked."""
    block = asked.orderBy("id").toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in block.columns]
    shared = asked.sparkSession.sparkContext.broadcast(_units(*columns) if len(block) else (np.zeros(0, np.int64), np.zeros((0, 1))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units = shared.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's place, id, score
        least = np.full(len(names), threshold)
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            ids, m = _units(batch.column(0), batch.column(1))
            for low in range(0, len(names), 2048):
                s = np.clip(units[low : low + 2048] @ m.T, -1, 1)
                s[names[low : low + 2048, None] == ids[None]] = -np.inf
                q, at = np.nonzero((np.round(s, 8) >= np.round(least[low : low + 2048, None], 8)) & (s >= threshold))
                new = (q + low, ids[at], s[q, at])
                kept = tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
            order = np.lexsort((kept[1], -np.round(kept[2], 8), kept[0]))
            kept = tuple(x[order] for x in kept)
            start = np.flatnonzero(np.concatenate([[True], kept[0][1:] != kept[0][:-1]])) if len(order) else order
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            kept = tuple(x[place < k] for x in kept)
            full = place[place < k] == k - 1
            least[kept[0][full]] = kept[2][full]
        yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", vec_id, "score"])

    return rows.mapInArrow(best, f"query_id long, `{vec_id}` long, score double")


def cache_lookup(queries: DataFrame, corpus: DataFrame, vec_id: str, vector: str, threshold: float) -> DataFrame:
    """``(query_id, hit_id, score)``: the best other entry of each query if it reaches the threshold; negative ones never do."""
    best = nearest(queries, corpus, vec_id, vector, 1, max(threshold, 0.0))
    return best.select("query_id", F.col(vec_id).alias("hit_id"), "score")


def mean_vectors(vectors: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """``(group, vector)``: the weighted mean of each group's vectors; partial sums per position."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = vectors.select(group, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
