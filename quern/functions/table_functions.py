"""Chunkers for SQL: SELECT * FROM chunk_words(TABLE(documents), 'text', 64, 50).

Each takes a table, the name of its text column, and its sizes, and gives the table's other columns with ``pos`` and ``chunk``. merge_pages takes the pages of
documents, as in merge_pages(TABLE(pages) PARTITION BY (doc) ORDER BY (page), 'text', 3, 24).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quern.operators.chunking import recursive_chunks
from quern.operators.cohesion import best_spans

#: White space as words() of functions.text has it.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _kept(table: AnalyzeArgument, column: AnalyzeArgument, names: list[str]) -> list[StructField]:
    """The table's columns without its text, which must be there; they must not have names of the result."""
    if not table.isTable or not isinstance(column.value, str):
        raise ValueError("the arguments are TABLE(...), the name of its text column, and sizes")
    fields = {f.name: f for f in table.dataType.fields}
    if column.value not in fields:
        raise ValueError(f"the table has no column {column.value!r}")
    kept = [f for name, f in fields.items() if name != column.value]
    if clash := {f.name for f in kept} & set(names):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    return kept


def _sized(column: str, *sizes: int) -> None:
    if any(not isinstance(size, int) or size < 0 for size in sizes):
        raise ValueError("sizes are whole numbers of 0 or more")


class _Chunker:
    """One row in, its chunks out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _sized(column.value, size.value, overlap.value)
        return AnalyzeResult(StructType([*_kept(table, column, ["pos", "chunk"]), StructField("pos", IntegerType()), StructField("chunk", StringType())]))

    def chunks(self, text: str, size: int, overlap: int) -> list[str]:
        raise NotImplementedError

    def eval(self, row: Row, column: str, size: int, overlap: int) -> Iterator[tuple]:
        fields = row.asDict(recursive=False)
        text = fields.pop(column)
        for pos, chunk in enumerate(self.chunks(text or "", size, overlap)):
            yield (*fields.values(), pos, chunk)


class ChunkWords(_Chunker):
    """Windows of ``size`` words, each max(size - overlap, 1) words after the last."""

    def chunks(self, text: str, size: int, overlap: int) -> list[str]:
        words, step = [w for w in _WHITE.split(text) if w], max(size - overlap, 1)
        starts = range(0, 1 if len(words) <= size else len(words) - size + step, step)
        return [" ".join(words[i : i + size]) for i in starts] if words else []


class ChunkRecursive(_Chunker):
    """Pieces of at most ``size`` characters by the coarsest separators that occur."""

    def chunks(self, text: str, size: int, overlap: int) -> list[str]:
        return recursive_chunks(text, size, overlap)


class MergePages:
    """Pages of one partition in their order, cut where their words change (see operators.cohesion): start_idx, end_idx and chunk beside the other columns of a
    chunk's first page."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, least: AnalyzeArgument, longest: AnalyzeArgument) -> AnalyzeResult:
        _sized(column.value, least.value, longest.value)
        if not 1 <= least.value <= longest.value:
            raise ValueError("chunks of least to longest pages, 1 or more")
        kept = _kept(table, column, ["start_idx", "end_idx", "chunk"])
        return AnalyzeResult(StructType([*kept, StructField("start_idx", IntegerType()), StructField("end_idx", IntegerType()), StructField("chunk", StringType())]))

    def __init__(self):
        self.pages: list[str] = []
        self.others: list[tuple] = []
        self.least = self.longest = 1

    def eval(self, row: Row, column: str, least: int, longest: int) -> None:
        fields = row.asDict(recursive=False)
        self.pages.append(fields.pop(column) or "")
        self.others.append(tuple(fields.values()))
        self.least, self.longest = least, longest

    def terminate(self) -> Iterator[tuple]:
        for start, end in best_spans([re.findall(r"\w+", page.lower()) for page in self.pages], self.longest, self.least):
            yield *self.others[start], start, end, "\n".join(self.pages[start : end + 1])


def register_chunkers(spark: SparkSession) -> None:
    """chunk_words, chunk_recursive and merge_pages in the session's SQL."""
    for name, kind in (("chunk_words", ChunkWords), ("chunk_recursive", ChunkRecursive), ("merge_pages", MergePages)):
        spark.udtf.register(name, udtf(kind))
