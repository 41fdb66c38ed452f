"""Retrieval queries: questions searched in the documents, vectors searched in the vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import text as tx
from concordat.functions import vectors as vx
from concordat.operators import retrieval as rt
from concordat.operators import similarity as sm
from concordat.operators.records import embedding_text
from concordat.plans.base import Registry
from concordat.runtime import cut_lineage, table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_SPLIT = r"string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
_WORDS = f"""
tok as (select doc_id, unnest({_SPLIT.format('text')}) as term from documents where text is not null),
kw as (select doc_id, term from tok where length(term) > 2 and term not in ({_STOP})),
tf as (select doc_id, term, count(*) as tf from kw group by all),
dl as (select d.doc_id, count(k.term) as dl from documents d left join kw k on d.doc_id = k.doc_id group by d.doc_id),
stats as (select count(distinct doc_id) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
ask as (select distinct question_id, unnest({_SPLIT.format('question_text')}) as term from question
        where question_text is not null and try_cast(regexp_extract(question_id, 'Q([0-9]+)$', 1) as int) % 20 = 0),
score as (select a.question_id, t.doc_id,
            sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * d.dl / s.avgdl))) as score
          from ask a join tf t on a.term = t.term join df f on t.term = f.term join dl d on t.doc_id = d.doc_id cross join stats s
          where length(a.term) > 2 and a.term not in ({_STOP}) group by all)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: questions whose number is divisible by 20."""
    number = F.regexp_extract("question_id", r"Q(\d+)$", 1).try_cast("int")
    return table(spark, sf_dir, "question").where(number % 20 == 0).select("question_id", "question_text")


def _best(spark: SparkSession, sf_dir: str, marked: Column | None = None) -> DataFrame:
    return rt.bm25_best(asked(spark, sf_dir), table(spark, sf_dir, "documents"), "question_id", "question_text", "doc_id", "text", 10, marked)


_CUT = "where question_text is not null and try_cast(regexp_extract(question_id, 'Q([0-9]+)$', 1) as int) % 20 = 0"


@_R.query(f"""with {_WORDS.replace(_CUT, "where question_text is not null")}
select question_id, doc_id, rank from (select question_id, doc_id, row_number() over (partition by question_id order by round(score, 8) desc, doc_id) as rank
from score where score > 0) where rank <= 10""")
def agg_03_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions searched in all documents."""
    questions, documents = table(spark, sf_dir, "question"), table(spark, sf_dir, "documents")
    return rt.bm25_best(questions, documents, "question_id", "question_text", "doc_id", "text", 10).select("question_id", "doc_id", "rank")


@_R.query(f"""with {_WORDS}
select n as n_docs, round(avgdl, 6) as avgdl, (select count(*) from df) as n_terms, (select sum(df) from df) as n_postings from stats""")
def agg_40_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = rt.document_lengths(docs, "doc_id", "text").agg(F.count_distinct("doc_id").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))
    terms = rt.term_frequencies(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))
    totals = terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return lengths.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one").drop("one")


@_R.query(f"""with {_WORDS} select doc_id, term, tf from tf""")
def agg_01_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@_R.query(f"""with {_WORDS} select term, df from df""")
def agg_02_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


def _ranked_sources(spark: SparkSession, sf_dir: str):
    """The two lists that are fused: book and video notes first in one, everything in the other."""
    notes = F.col("source").isin("book_note", "video_note")
    best = cut_lineage(_best(spark, sf_dir, notes).drop("rank"))
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = best.where("marked").join(sources.where(notes), "doc_id")
    return tuple(rt.top_k(found, "question_id", "score", "doc_id", 10) for found in (first, best.where("not marked").join(sources, "doc_id")))


_FUSED = f"""with {_WORDS},
s as (select score.*, source from score join documents using (doc_id) where score > 0),
d as (select * from (select question_id, doc_id, row_number() over (partition by question_id order by round(score, 8) desc, doc_id) as dense_rank
      from s where source in ('book_note', 'video_note')) where dense_rank <= 10),
p as (select * from (select question_id, doc_id, row_number() over (partition by question_id order by round(score, 8) desc, doc_id) as sparse_rank
      from s) where sparse_rank <= 10),
f as (select coalesce(d.question_id, p.question_id) as question_id, coalesce(d.doc_id, p.doc_id) as doc_id, dense_rank, sparse_rank,
        coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0) as hybrid,
        case when sparse_rank is null then 'dense_only' when dense_rank is null then 'sparse_only' else 'both' end as source
      from d full outer join p on d.question_id = p.question_id and d.doc_id = p.doc_id)
"""


@_R.query(_FUSED + """select question_id, doc_id, dense_rank, sparse_rank, source, rank from (select *, row_number() over
(partition by question_id order by round(hybrid, 8) desc, doc_id) as rank from f) where rank <= 6""")
def agg_04_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = _ranked_sources(spark, sf_dir)
    return rt.fuse(dense, sparse, "question_id", "doc_id").select("question_id", "doc_id", "dense_rank", "sparse_rank", "source", "rank")


@_R.query(_FUSED + """select source, count(*) as n, round(avg(hybrid), 8) as mean_score from f group by source""")
def agg_43_merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = _ranked_sources(spark, sf_dir)
    fused = rt.fuse(dense, sparse, "question_id", "doc_id", k=1000)
    return fused.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("hybrid_score"), 8).alias("mean_score"))


_HYBRID = (
    "with " + _WORDS.replace("ask as (select distinct question_id", "ask as (select distinct doc_id as question_id").replace(_SPLIT.format("question_text"), _SPLIT.format("subject"))
    .replace("from question\n", "from documents\n").replace("where question_text is not null and try_cast(regexp_extract(question_id, 'Q([0-9]+)$', 1) as int) % 20 = 0", "where subject is not null and doc_id % 20 = 0 and doc_id in (select vec_id from embeddings)")
    + """,
pairs as (select a.vec_id as question_id, b.vec_id as doc_id,
  list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as score
  from embeddings a, embeddings b where a.vec_id in (select doc_id from documents where subject is not null and doc_id % 20 = 0) and a.vec_id <> b.vec_id),
d as (select * from (select question_id, doc_id, row_number() over (partition by question_id order by round(score, 8) desc, doc_id) as dense_rank from pairs) where dense_rank <= 10),
p as (select * from (select question_id, doc_id, row_number() over (partition by question_id order by round(score, 8) desc, doc_id) as sparse_rank from score where score > 0) where sparse_rank <= 10),
f as (select coalesce(d.question_id, p.question_id) as query_id, coalesce(d.doc_id, p.doc_id) as doc_id, dense_rank, sparse_rank,
        coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0) as hybrid
      from d full outer join p on d.question_id = p.question_id and d.doc_id = p.doc_id)
select query_id, doc_id, dense_rank, sparse_rank, rank from (select *, row_number() over (partition by query_id order by round(hybrid, 8) desc, doc_id) as rank from f) where rank <= 6"""
)


@_R.query(_HYBRID)
def jon_05_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword search fused: documents whose id is divisible by 20 ask by their vector and by the words of their subject."""
    documents, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    asking = documents.where("subject is not null and doc_id % 20 = 0").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    asking = cut_lineage(asking.select(F.col("doc_id").alias("query_id"), "subject", "embedding"))
    dense = rt.nearest(asking.select(F.col("query_id").alias("vec_id"), "embedding"), vectors, "vec_id", "embedding", 10).withColumnRenamed("vec_id", "doc_id")
    sparse = rt.bm25_best(asking, documents, "query_id", "subject", "doc_id", "text", 10)
    return rt.fuse(dense, sparse, "query_id", "doc_id").select("query_id", "doc_id", "dense_rank", "sparse_rank", "rank")


_KNN = """with pairs as (select a.vec_id as query_id, b.vec_id,
  list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))) as score
  from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
"""


def _vectors(spark: SparkSession, sf_dir: str):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.where("vec_id % 20 = 0"), vectors


@_R.query(_KNN + """select query_id, vec_id, rank from (select *, row_number() over (partition by query_id order by round(score, 8) desc, vec_id) as rank from pairs) where rank <= 5""")
def srt_04_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _vectors(spark, sf_dir)
    return rt.nearest(queries, vectors, "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@_R.query(_KNN + """select query_id, vec_id, label % 2 as collection, rank from (select p.*, e.label, row_number() over (partition by query_id order by round(score, 8) desc, p.vec_id) as rank
from pairs p join embeddings e on p.vec_id = e.vec_id where score >= 0.1) where rank <= 10""")
def srt_01_two_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both collections searched and merged: the ten best above the threshold."""
    queries, vectors = _vectors(spark, sf_dir)
    parts = [rt.nearest(queries, vectors.where(f"label % 2 = {c}"), "vec_id", "embedding", 10, 0.1) for c in (0, 1)]
    labels = vectors.select("vec_id", (F.col("label") % 2).alias("collection"))
    both = parts[0].unionByName(parts[1]).drop("rank")
    return rt.top_k(both.join(labels, "vec_id"), "query_id", "score", "vec_id", 10).select("query_id", "vec_id", "collection", "rank")


@_R.query(_KNN + """select query_id, hit_id from (select query_id, vec_id as hit_id, row_number() over (partition by query_id order by round(score, 8) desc, vec_id) as r from pairs where score >= 0.3) where r = 1""")
def jon_04_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, vectors = _vectors(spark, sf_dir)
    return rt.cache_lookup(queries, vectors, "vec_id", "embedding", 0.3).select("query_id", "hit_id")


@_R.query("""select label, pos, round(avg(x), 6) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all""")
def agg_42_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rt.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@_R.query("""select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as length from embeddings""")
def scl_18_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm("embedding"), 6).alias("length"))


@_R.query("""select label % 2 as collection, count(*) as n, min(len(embedding)) as dims from embeddings group by 1""")
def agg_41_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 2).alias("collection")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dims"))


@_R.query(r"""select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as plain, md5(text) as text_key,
length(text) // 4 as token_estimate, case when length(text) > 200 then left(text, 200) || '...' else text end as snippet from documents where text is not null""")
def scl_01_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", tx.normalised("text").alias("plain"), tx.cache_key("", "text").alias("text_key"), tx.token_estimate("text").cast("long").alias("token_estimate"), tx.snippet("text").alias("snippet"))


@_R.query(r"""select doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) as sentences from documents where text is not null""")
def scl_09_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tx.sentences("text")).alias("sentences"))


@_R.query(f"""with {_WORDS},
pos as (select doc_id, term, i from (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as i from (select doc_id, list_filter({_SPLIT.format('text')}, lambda t: length(t) > 2 and t not in ({_STOP})) as w from documents where text is not null))),
c as (select doc_id, term, count(*) as count, min(i) as first_at from pos group by all)
select doc_id, term, count, rank from (select *, row_number() over (partition by doc_id order by count desc, first_at) as rank from c) where rank <= 5""")
def agg_38_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.top_keywords(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@_R.query(f"""with q as (select question_id, list_distinct({_SPLIT.format('question_text')}) as w from question where question_text is not null),
r as (select r.response_id, q.w, list_distinct({_SPLIT.format('r.reasoning')}) as v from response r join q on r.question_id = q.question_id where reasoning is not null)
select response_id, round(len(list_intersect(w, v)) / nullif(len(list_distinct(list_concat(w, v))), 0), 6) as jaccard from r""")
def set_04_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a question's words its answers share."""
    questions = table(spark, sf_dir, "question").where("question_text is not null").select("question_id", F.array_distinct(tx.tokens("question_text")).alias("w"))
    answers = table(spark, sf_dir, "response").where("reasoning is not null").select("response_id", "question_id", F.array_distinct(tx.tokens("reasoning")).alias("v"))
    return answers.join(questions, "question_id").select("response_id", F.round(sm.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@_R.query(r"""select question_id, concat_ws(' ', question_text, array_to_string(list_transform(list_sort(map_keys(options)), lambda k: k || ': ' || options[k]), ' ')) as embedding_text
from question where options is not null and question_text is not null""")
def prj_24_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "question").where("options is not null and question_text is not null")
    return questions.select("question_id", embedding_text(F.col("question_text"), F.col("options")).alias("embedding_text"))
