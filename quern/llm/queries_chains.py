"""op3: documents that share passages, with their classes, links and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.chains import passage_holders, repeated_passages
from quern.session import table
from quern.workspace import materialize


def op3_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_holders(materialize(repeated_passages(table(spark, sf_dir, "documents")), "chain-links"))


QUERIES = {"op3_chains": op3_chains}
ORACLES: dict[str, str] = {}
