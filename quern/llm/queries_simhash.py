"""op1: near-duplicate classes of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.simhash import near_duplicate_classes
from quern.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"), "doc_id", "text", shingle_words=3, max_distance=2)
    return classes.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
