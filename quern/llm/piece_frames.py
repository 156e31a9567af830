"""SentencePiece encoding and decoding of DataFrame columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pieces import encoder
from quern.llm.workers import no_cycles

ROWS_AT_ONCE = 512


def _lists(coded: list[bytes]) -> pa.Array:
    values = np.frombuffer(b"".join(coded), dtype="<i4")
    offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(id, n_tokens, ids array<int>) of every row; with check also decoded_equal, whether decoding the ids gives the text again.

    Null texts are empty and give no ids. Decoding differs from a text only where that holds U+2581, which the model takes for a space.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                with no_cycles():
                    coded = coder.encode_batch(texts)
                columns = [batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), _lists(coded)]
                if check:
                    columns.append(pa.array([coder.decode(np.frombuffer(c, dtype="<i4").tolist()) == t for c, t in zip(coded, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded_equal"][: len(columns)])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(of_batches, "id long, n_tokens long, ids array<int>" + ", decoded_equal boolean" * check)


def decode_pieces(coded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids give null."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(of_batches, "id long, text string")
