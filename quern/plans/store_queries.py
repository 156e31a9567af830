"""Queries on tables that grow and on rows of other times: versioned stores, a growing index, an approximate one, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import asof, retrieval, vector_index
from quern.plans.search_queries import ORACLES as SEARCH
from quern.session import spread, table
from quern.sources.segments import GrowingIndex
from quern.sources.versions import VersionedTable
from quern.workspace import fresh_path


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after an addition, an upsert with late and newer rows, a deletion, a repeated batch and a compaction: its third and its last version."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("store"), F.col("doc_id").cast("string").alias("rel_path"), F.lit(2).alias("version"), F.length("text").cast("long").alias("size"))
    store = VersionedTable(spark, fresh_path(spark, "versions"), ["store", "rel_path"], "version")
    store.upsert(docs, "first", 0)
    store.upsert(docs.withColumn("version", F.when(F.col("size") > 1000, 3).otherwise(1)).withColumn("size", -F.col("size")), "second", 0)
    third = store.delete(docs.where("size < 200"))
    store.compact()
    store.upsert(docs.withColumn("size", F.lit(0).cast("long")), "second", 0)  # this batch was there before
    last = store.upsert(docs.where("size < 100").withColumn("version", F.lit(1)), "third", 0)
    return store.read(third).withColumn("at", F.lit("third")).unionByName(store.read(last).withColumn("at", F.lit("last")))


def bm25_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an index that took documents in three additions, lost copies that one of them held, and was merged."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    copies = docs.select("source", (-F.col("doc_id") - 1).alias("doc_id"), F.upper("text").alias("text"))
    grown = GrowingIndex(spark, fresh_path(spark, "grown"))
    grown.add(docs.where("length(text) < 500"))
    grown.add(docs.where("length(text) >= 500 and length(text) < 2000").unionByName(copies))
    grown.delete(copies.select(F.col("source").alias("store"), F.col("doc_id").alias("doc")))
    grown.add(docs.where("length(text) >= 2000"))
    grown.merge(most_docs=docs.count() // 2)
    found = retrieval.lexical_topk(grown.index(), table(spark, sf_dir, "benchmark"), 4, 5, "concat")
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "store", "doc", F.round("score", 6).alias("score"))


def reading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the newest error of its user before it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), F.col("value").alias("error_value"))
    found = asof.asof_join(events.select("user_id", "event_id", "ts"), errors, ["user_id"], "ts", "ts", ["error_id", "error_value"], ["error_id"], exact=False)
    return found.select("user_id", "event_id", F.unix_micros(F.col("found_time").cast("timestamp")).alias("found_us"), "error_id", "error_value")


def reading_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the newest reading of its user and type up to it that is no older than six hours."""
    events = table(spark, sf_dir, "events")
    requests = events.select("user_id", "event_id", "ts", "event_type")
    recent = F.col("found_time") >= F.col("ts") - F.expr("interval 6 hours")
    found = asof.asof_join(requests, events.select("user_id", F.lit("view").alias("event_type"), "ts", "value").where("event_type = 'view'"), ["user_id", "event_type"], "ts", "ts", ["value"], ["value"], tolerance=recent)
    return found.select("user_id", "event_id", "event_type", "value")


def _index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    return vector_index.build_vector_index(table(spark, sf_dir, "embeddings"))


def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of dense_topk_merge through an approximate index: scores are exact, a tenth of the documents may be others."""
    found = vector_index.approximate_topk(_index(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0"))
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "store", "doc", F.round("score", 6).alias("score"))


def dense_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each store of the index holds, opened after it was written: every vector, and what its coded direction is off by at most."""
    folder = fresh_path(spark, "vector-index")
    vector_index.write_vector_index(_index(spark, sf_dir), folder)
    rows = vector_index.open_vector_index(spark, folder).rows
    return rows.groupBy("store").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("doc").alias("n_distinct"), F.sum("doc").alias("doc_sum"))


QUERIES = {f.__name__: f for f in (store_versions, bm25_grown, reading_asof, reading_recent, dense_index_topk, dense_index_rows)}

ORACLES = {
    "store_versions": """WITH d AS (SELECT source AS store, doc_id::VARCHAR AS rel_path, length(text)::BIGINT AS size FROM documents),
        v AS (SELECT store, rel_path, size AS n, CASE WHEN size > 1000 THEN 3 ELSE 2 END::INT AS version, CASE WHEN size > 1000 THEN -size ELSE size END AS size FROM d)
        SELECT store, rel_path, version, size, 'third' AS at FROM v WHERE n >= 200 UNION ALL SELECT store, rel_path, version, size, 'last' FROM v WHERE n >= 200
        UNION ALL SELECT store, rel_path, 1, size, 'last' FROM d WHERE size < 100""",
    "bm25_grown": SEARCH["bm25_topk_concat"],
    "reading_asof": """SELECT e.user_id, e.event_id, epoch_us(r.ts) AS found_us, r.event_id AS error_id, r.value AS error_value
        FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON e.user_id = r.user_id AND e.ts > r.ts""",
    "reading_recent": """SELECT e.user_id, e.event_id, e.event_type, CASE WHEN r.ts >= e.ts - INTERVAL 6 HOUR THEN r.value END AS value
        FROM events e ASOF LEFT JOIN (SELECT user_id, 'view' AS event_type, ts, value FROM events) r ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.ts >= r.ts""",
    "dense_index_rows": "SELECT label::VARCHAR AS store, count(*) AS n_docs, count(DISTINCT vec_id) AS n_distinct, sum(vec_id)::BIGINT AS doc_sum FROM embeddings GROUP BY label",
}
