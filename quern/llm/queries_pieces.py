"""op7: SentencePiece encoding and decoding of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm.piece_frames import encode_pieces
from quern.session import table


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_pieces": op7_pieces}
ORACLES: dict[str, str] = {}
