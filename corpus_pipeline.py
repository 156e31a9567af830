"""A corpus made ready for training: quality rules, near-duplicates, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
``documents``, and any others that docs has, whatever their names; the last returns each document's ids. An empty table gives an empty one.

Rows that share a doc_id are one document where a stage drops documents: they go together if one of them breaks a quality rule or holds a benchmark item, and stay
together if one of them names its class of near duplicates. Rows without a doc_id count as one document to the first rule and never go
as near duplicates. Null texts are empty: they break the quality rules, hold nothing, stay null where texts are redacted and have no ids. Of equally good
near duplicates the smallest doc_id stays. Texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import drop_contaminated
from quern.llm.piece_frames import encode_pieces
from quern.llm.pii import redact
from quern.llm.quality import keep_good
from quern.llm.similar import keep_one_of_similar
from quern.session import table
from quern.workspace import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash fingerprints as op1 links them, and by an exact search for similar texts that are out of their reach."""
    return keep_one_of_similar(docs, shingle_words=5, max_distance=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans replaced by their kinds, and n_chars to match."""
    redacted = redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: SQL cannot say classes of similar texts, redaction or piece encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
