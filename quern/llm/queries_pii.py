"""op9: personal data in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import pii
from quern.session import table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(F.expr(pii.listed("base")), "UTF-8"), 256).alias("base_sha256"), F.expr(pii.listed("concat(base, added)")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
