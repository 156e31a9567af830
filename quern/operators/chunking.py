"""Chunkers: text to ordered chunks. Sizes are words in fixed_size and lumber, characters in recursive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import models
from quern.functions.judging import flag
from quern.functions.prompts import render
from quern.functions.text import strip, unfence, words
from quern.functions.vectors import cosine

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 128, overlap: int = 10) -> DataFrame:
    """(id, pos, chunk): windows of ``size`` words, each beginning max(size - overlap, 1) words after the last, up to the first that reaches the end."""
    step = max(size - overlap, 1)
    split = docs.select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    count = F.expr(f"IF(size(w) <= {size}, 1, CAST(ceil((size(w) - {size}) / {step}) AS int) + 1)")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("w", i * step + 1, F.lit(size)), " "))
    return split.select(id_col, F.posexplode(windows).alias("pos", "chunk"))


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters where separators allow, cut at the coarsest separator that occurs and merged with ``overlap`` characters shared."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        pieces = [p for p in [first, *(mark + r for r in rest)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += _merge(held, size, overlap)
        held = []
        out += recursive_chunks(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(held, size, overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            joined = "".join(window).strip()
            if joined:
                out.append(joined)
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    joined = "".join(window).strip()
    return out + [joined] if joined else out


def recursive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 128, overlap: int = 50) -> DataFrame:
    """(id, pos, chunk) by recursive_chunks()."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t or "", size, overlap))

    return docs.select(id_col, F.posexplode(split(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "chunk"))


def semantic_groups(rows: DataFrame, doc_col: str, order_col: str, vector_col: str, percentile: float = 0.9) -> DataFrame:
    """rows with ``chunk_no``: within a document a chunk ends where the distance to the next vector lies above the percentile of its distances.

    A zero vector has no distance to others; its document then has no breaks, as the percentile is undefined.
    """
    order = W.partitionBy(doc_col).orderBy(order_col)
    spaced = rows.withColumn("__d", 1 - cosine(F.col(vector_col), F.lead(vector_col).over(order)))
    bounds = spaced.groupBy(doc_col).agg(F.expr(f"percentile(__d, {percentile})").alias("__t"), F.coalesce(F.bool_or(F.isnan("__d")), F.lit(False)).alias("__nan"))
    broken = spaced.join(bounds, doc_col).withColumn("__b", (~F.col("__nan") & F.coalesce(F.col("__d") > F.col("__t"), F.lit(False))).cast("long"))
    return broken.withColumn("chunk_no", F.coalesce(F.sum("__b").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__d", "__t", "__nan", "__b")


def semantic(sentences: DataFrame, doc_col: str, order_col: str, text_col: str, vector_col: str, percentile: float = 0.9) -> DataFrame:
    """(doc, chunk_no, chunk): sentences of each group joined by blanks, in order."""
    grouped = semantic_groups(sentences, doc_col, order_col, vector_col, percentile)
    parts = F.array_sort(F.collect_list(F.struct(order_col, text_col)))
    return grouped.groupBy(doc_col, "chunk_no").agg(F.array_join(F.transform(parts, lambda s: s[text_col]), " ").alias("chunk"))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), separator), strip), "")


def lumber_spans(texts: list[str], cap: int, boundary: Callable[[list[str]], int | None] | None = None) -> list[tuple[int, int]]:
    """(first, last) paragraph of each chunk, both inclusive.

    Paragraphs gather while their words stay within the cap; one beyond it stands alone. A gathered group of
    several is cut behind the paragraph that ``boundary`` names (clamped; the last on failure), and gathering goes on from there.
    """
    sizes, spans, first = [len(t.split()) for t in texts], [], 0
    while first < len(texts):
        last, total = first, sizes[first]
        while last + 1 < len(texts) and total + sizes[last + 1] <= cap:
            last += 1
            total += sizes[last]
        if boundary is not None and last > first:
            named = boundary(texts[first : last + 1])
            if named is not None:
                last = first + max(0, min(int(named), last - first))
        spans.append((first, last))
        first = last + 1
    return spans


def lumber(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 128, separator: str = "\n\n", boundary: Callable[[list[str]], int | None] | None = None) -> DataFrame:
    """(id, pos, start_idx, end_idx, chunk) by lumber_spans(), paragraphs joined by blank lines."""

    @F.pandas_udf("array<struct<start_idx:int,end_idx:int>>")
    def spans(batch: pd.Series) -> pd.Series:
        return batch.map(lambda texts: [{"start_idx": a, "end_idx": b} for a, b in lumber_spans(list(texts), cap, boundary)])

    split = docs.select(id_col, paragraphs(F.col(text_col), separator).alias("p"))
    cut = split.select(id_col, "p", F.posexplode(spans("p")).alias("pos", "s"))
    return cut.select(id_col, "pos", "s.start_idx", "s.end_idx", F.array_join(F.slice("p", F.col("s.start_idx") + 1, F.col("s.end_idx") - F.col("s.start_idx") + 1), "\n\n").alias("chunk"))


def merge_pages(pages: DataFrame, doc_col: str, order_col: str, text_col: str, is_boundary: Callable[[str, str], bool] | None = None, least: int = 3, tail: int = 2000) -> DataFrame:
    """(doc, pos, start_idx, end_idx, chunk): pages gather; from ``least`` gathered pages on, ``is_boundary`` (last characters, next page) may close the chunk. Its failures close nothing."""

    def fold(texts: list[str]) -> list[dict]:
        out, start = [], 0
        for i in range(1, len(texts) + 1):
            closing = i == len(texts)
            if not closing and i - start >= least and is_boundary is not None:
                try:
                    closing = bool(is_boundary("\n".join(texts[start:i])[-tail:], texts[i]))
                except Exception:  # noqa: BLE001 - a model that fails closes no chunk
                    closing = False
            if closing:
                out.append({"start_idx": start, "end_idx": i - 1, "chunk": "\n".join(texts[start:i])})
                start = i
        return out

    @F.pandas_udf("array<struct<start_idx:int,end_idx:int,chunk:string>>")
    def folded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda texts: fold([t or "" for t in texts]))

    gathered = pages.groupBy(doc_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda p: p[text_col]).alias("texts"))
    return gathered.select(doc_col, F.posexplode(folded("texts")).alias("pos", "c")).select(doc_col, "pos", "c.*")


def agentic(docs: DataFrame, summarize: models.ChatModel, split: models.ChatModel, id_col: str = "doc_id", text_col: str = "text", keep_summary: bool = True) -> DataFrame:
    """(id, pos, summary, chunk): a model sums up each text, then splits it into [{"chunk": ...}].

    Texts whose split cannot be read stay whole. With keep_summary (batches) they keep their summary, else (single texts) it is empty.
    """
    summed = docs.withColumn("summary", F.coalesce(models.column(summarize, render("summary", text=F.col(text_col))), F.lit("")))
    answer = F.from_json(unfence(models.column(split, render("split", summary=F.col("summary"), text=F.col(text_col)))), "array<struct<chunk:string>>")
    parts = summed.withColumn("__p", F.array_remove(F.filter(F.transform(answer, lambda c: strip(c["chunk"])), lambda c: c.isNotNull()), ""))
    failed = F.col("__p").isNull() | (F.size("__p") == 0)
    whole = parts.withColumn("__q", F.when(failed, F.array(F.col(text_col))).otherwise(F.col("__p")))
    summary = F.col("summary") if keep_summary else F.when(failed, "").otherwise(F.col("summary"))
    return whole.withColumn("summary", summary).select(id_col, "summary", F.posexplode("__q").alias("pos", "chunk"))


def to_prose(pages: DataFrame, convert: models.ChatModel, text_col: str = "text", decide: models.ChatModel | None = None) -> DataFrame:
    """pages with ``prose``: blank pages and, with ``decide``, useless ones go; pages whose conversion is empty go too."""
    rows = pages.where(F.length(strip(F.coalesce(F.col(text_col), F.lit("")))) > 0)
    if decide is not None:
        rows = rows.where(flag(models.column(decide, render("useful", text=F.col(text_col)))))
    return rows.withColumn("prose", strip(models.column(convert, render("prose", text=F.col(text_col))))).where(F.length("prose") > 0)
