"""Queries on indexes: BM25, dense search, merges, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import models
from quern.functions import metrics
from quern.functions.prompts import render
from quern.functions.vectors import cosine
from quern.operators import chunking, ranking, records, retrieval
from quern.session import spread, table
from quern.sources import scans, sinks
from quern.workspace import fresh_path, materialize


def _index(spark: SparkSession, sf_dir: str) -> retrieval.LexicalIndex:
    """The index of documents, built when they are first asked for and opened from then on."""
    docs = table(spark, sf_dir, "documents")
    return scans.stored_lexical(docs, "documents", lambda folder: retrieval.lexical_index(spread(docs), folder=folder))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    terms = index.terms.groupBy("store").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return index.stats.join(terms, "store").select("store", "n_docs", F.round("avg_length", 6).alias("avg_length"), F.round("floor", 6).alias("floor"), "n_terms", "n_postings")


def _topk(spark: SparkSession, sf_dir: str, merge: str) -> DataFrame:
    found = retrieval.lexical_topk(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), 4, 5, merge)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "store", "doc", F.round("score", 6).alias("score"))


def bm25_topk_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "concat")


def bm25_topk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "score")


def bm25_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an index that was written and opened again."""
    folder = fresh_path(spark, "lexical-store")
    sinks.write_lexical(_index(spark, sf_dir), folder)
    found = retrieval.lexical_topk(scans.open_lexical(spark, folder), table(spark, sf_dir, "benchmark"), 4, 5, "concat")
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "store", "doc", F.round("score", 6).alias("score"))


def chunk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents as the corpus: best chunk per question over all stores."""
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.fixed_size(spread(docs), size=128, overlap=10).withColumn("doc", F.concat_ws("#", "doc_id", F.format_string("%06d", "pos"))).withColumn("store", F.lit("all"))
    index = scans.stored_lexical(docs, "chunks-128-10", lambda folder: retrieval.lexical_index(chunks, "store", "doc", "chunk", folder=folder))
    return retrieval.lexical_topk(index, table(spark, sf_dir, "benchmark"), 1, 1).select("qid", "doc", F.round("score", 6).alias("score"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.dense_topk(vectors, vectors.where("vec_id % 20 = 0"))


def dense_topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("qid", F.col("rank").cast("long").alias("rank"), "store", "doc", F.round("score", 6).alias("score"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of dense search as lists of names, with the query's own store as gold."""
    listed = _dense(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.lit("").alias("filename"), F.col("store").alias("rel_path"))).alias("gen_docs"))
    gold = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.array(((F.col("label") + 1) % 10).cast("string"), (F.col("label") % 3).cast("string")).alias("ref_docs"))
    return listed.join(gold, "qid")


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("qid", metrics.recall_hit(F.col("ref_docs"), F.col("gen_docs")).alias("recall"), F.round(metrics.reciprocal_rank(F.col("ref_docs"), F.col("gen_docs")), 6).alias("mrr"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("store"), F.col("doc_id").cast("string").alias("rel_path"), F.lit(1).alias("version"), F.length("text").alias("size"))
    newer = docs.where("size > 1000").withColumn("version", F.lit(2)).withColumn("size", F.col("size") + 1)
    return retrieval.upsert(docs.unionByName(newer), ["store", "rel_path"], "version")


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = retrieval.lexical_topk(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), 1, 3, "score")
    return retrieval.gather_context(found, docs).select("qid", F.length("context").cast("long").alias("n_chars"), F.sha2(F.col("context").cast("binary"), 256).alias("sha"), F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, gather context, answer with the stand-in model."""
    docs, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = retrieval.lexical_topk(_index(spark, sf_dir), questions, 1, 1, "score")
    asked = questions.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    asked = retrieval.gather_context(found, docs, questions=asked).join(asked, "qid")
    prompt = render("answer_context", context=F.col("context"), question=F.col("question"))
    return asked.select("qid", *records.shape_answer("llm", models.column(models.echo_model, prompt)))


def rerank_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of twenty candidates of each question by a ranker that was fitted to fragments of about 400 documents."""
    docs, index = table(spark, sf_dir, "documents"), _index(spark, sf_dir)
    contents = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))

    def candidates(questions: DataFrame) -> DataFrame:
        found = retrieval.lexical_topk(index, questions, 20, 20, "score", qid_col="qid", text_col="question")
        return ranking.with_features(found, questions, contents)

    fragments = materialize(ranking.planted_questions(docs, 400), "fragments")
    judged = candidates(fragments).withColumn("label", (F.col("doc") == F.col("qid")).cast("int"))
    ranker = ranking.fit_ranker(judged)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return ranker.rerank(candidates(asked), 5).select("qid", F.col("rank").cast("long").alias("rank"), "doc", F.round("rerank_score", 6).alias("score"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (bm25_stats, bm25_reopened, bm25_topk_concat, bm25_topk_score, chunk_bm25, dense_topk_merge, retrieval_scores, upsert_latest, context_join, rag_answer, rerank_learned, cosine_pairs)}

_BAG = r"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


def _bm25_sql(corpus: str, k_each: int, top_k: int, order: str) -> str:
    """corpus: SQL giving store, doc, text."""
    return f"""WITH toks AS (SELECT store, doc, {_BAG.format(text="text")} AS t FROM ({corpus})),
    tf AS (SELECT store, doc, term, count(*) AS tf FROM (SELECT store, doc, unnest(t) AS term FROM toks) GROUP BY ALL),
    sizes AS (SELECT store, count(*) AS n, avg(len(t)) AS avgl FROM toks GROUP BY store),
    df AS (SELECT store, term, count(*) AS df FROM tf GROUP BY ALL),
    raw AS (SELECT df.*, n, avgl, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN sizes USING (store)),
    floors AS (SELECT store, 0.25 * avg(idf) AS floor FROM raw GROUP BY store),
    weights AS (SELECT store, term, avgl, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM raw JOIN floors USING (store)),
    q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_BAG.format(text="text")}) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT qid, store, doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgl))) AS score FROM q JOIN tf USING (term) JOIN weights USING (store, term) JOIN toks USING (store, doc) GROUP BY ALL),
    everyone AS (SELECT b.item_id AS qid, toks.store, toks.doc, round(coalesce(score, 0), 9) AS score FROM benchmark b CROSS JOIN toks LEFT JOIN scored s ON s.qid = b.item_id AND s.store = toks.store AND s.doc = toks.doc),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid, store ORDER BY score DESC, doc DESC) AS rn FROM everyone QUALIFY rn <= {k_each}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM best QUALIFY rank <= {top_k})"""


_DOCS = "SELECT source AS store, doc_id AS doc, text FROM documents"
_RANKED = "SELECT qid, rank, store, doc, round(score, 6) AS score FROM ranked"
_DENSE = """WITH s AS (SELECT q.vec_id AS qid, v.label::VARCHAR AS store, v.vec_id AS doc, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
        / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY qid, store ORDER BY round(score, 12) DESC, doc) AS rn FROM s QUALIFY rn <= 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, store, rn) AS rank FROM best QUALIFY rank <= 5)"""
_CHUNKS = r"""SELECT 'all' AS store, doc_id || '#' || lpad(i::VARCHAR, 6, '0') AS doc, array_to_string(w[i * 118 + 1:i * 118 + 128], ' ') AS text FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 128 THEN 1 ELSE ceil((len(w) - 128) / 118.0)::INT + 1 END)) AS i
    FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)"""

ORACLES = {
    "bm25_stats": f"""{_bm25_sql(_DOCS, 4, 5, "store, rn")} SELECT s.store, s.n AS n_docs, round(s.avgl, 6) AS avg_length, round(f.floor, 6) AS floor, count(*) AS n_terms, sum(df)::BIGINT AS n_postings
        FROM sizes s JOIN floors f USING (store) JOIN df USING (store) GROUP BY ALL""",
    "bm25_topk_concat": _bm25_sql(_DOCS, 4, 5, "store, rn") + _RANKED,
    "bm25_reopened": _bm25_sql(_DOCS, 4, 5, "store, rn") + _RANKED,
    "bm25_topk_score": _bm25_sql(_DOCS, 4, 5, "score DESC, store, rn") + _RANKED,
    "chunk_bm25": _bm25_sql(_CHUNKS, 1, 1, "store, rn") + "SELECT qid, doc, round(score, 6) AS score FROM ranked",
    "dense_topk_merge": f"{_DENSE} {_RANKED}",
    "retrieval_scores": f"""{_DENSE}, hits AS (SELECT r.qid, r.rank, r.store IN (((e.label + 1) % 10)::VARCHAR, (e.label % 3)::VARCHAR) AS hit FROM ranked r JOIN embeddings e ON e.vec_id = r.qid)
        SELECT qid, max(hit::INT)::DOUBLE AS recall, round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0), 6)::DOUBLE AS mrr FROM hits GROUP BY qid""",
    "upsert_latest": "SELECT source AS store, doc_id::VARCHAR AS rel_path, CASE WHEN length(text) > 1000 THEN 2 ELSE 1 END::INT AS version, (length(text) + (length(text) > 1000)::INT)::INT AS size FROM documents",
    "context_join": _bm25_sql(_DOCS, 1, 3, "score DESC, store, rn") + """SELECT qid, length(c)::BIGINT AS n_chars, sha256(c) AS sha, docs FROM (SELECT qid, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS c, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS docs
        FROM ranked JOIN documents d ON d.doc_id = ranked.doc WHERE d.text <> '' GROUP BY qid)""",
    "rag_answer": "SELECT item_id AS qid, trim(string_split('Question: ' || text, chr(10))[-1]) AS generated, 'llm' AS agent FROM benchmark",
    "cosine_pairs": """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
}
