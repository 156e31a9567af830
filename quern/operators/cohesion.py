"""Boundaries without a model: the cut of a text into stretches that each keep to few words, best over all cuts.

A stretch of n words costs what its words cost under its own add-one smoothed word frequencies, n log(n + k) less the sum of f log(f + 1) over the
counts f of its words, k being the number of different words of the text; each stretch costs the logarithm of the text's length besides, so that cuts must pay.
Dynamic programming finds the cheapest cut whose stretches have ``least`` to ``longest`` units (sentences, pages); fewer units than ``least`` are one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import bag, sentences

LONGEST = 24


def stretch_cost(units: list[list[str]], words: int, vocabulary: int) -> float:
    """What units cost as one stretch of a text with so many words, so many different."""
    tokens = [w for unit in units for w in unit]
    counts = pd.Series(tokens, dtype=object).value_counts().to_numpy() if tokens else np.zeros(0)
    return float(len(tokens) * np.log(len(tokens) + vocabulary) - (counts * np.log(counts + 1)).sum() + np.log(max(words, 1))) if vocabulary else 0.0


def best_spans(units: list[list[str]], longest: int = LONGEST, least: int = 1) -> list[tuple[int, int]]:
    """(first, last) unit of each stretch of the cheapest cut; of equal ones that whose last stretches are longest.

    All open stretches that end at a unit are extended by it at once: a row of counts per start, at most ``longest`` of them.
    """
    n = len(units)
    if n <= least:
        return [(0, n - 1)] if n else []
    numbers: dict[str, int] = {}
    coded = [np.unique([numbers.setdefault(w, len(numbers)) for w in unit], return_counts=True) if unit else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for unit in units]
    total, k = sum(map(len, units)), len(numbers)
    if not k:
        k = 1
    gains = np.arange(total + 1) * np.log(np.arange(total + 1) + 1.0)
    each = np.log(max(total, 1))
    counts = np.zeros((longest, k), dtype=np.int32)
    gained, lengths = np.zeros(longest), np.zeros(longest)
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = 0.0
    for j, (ids, added) in enumerate(coded):
        row = j % longest
        counts[row], gained[row], lengths[row] = 0, 0.0, 0.0
        before = counts[:, ids]
        gained += (gains[before + added] - gains[before]).sum(axis=1)
        counts[:, ids] = before + added
        lengths += len(units[j])
        starts = np.arange(max(0, j + 1 - longest), j + 2 - least) if j + 1 >= least else np.zeros(0, np.int64)
        if len(starts):
            at = starts % longest
            costs = best[starts] + lengths[at] * np.log(lengths[at] + k) - gained[at] + each
            pick = int(np.argmin(np.round(costs, 9)))
            best[j + 1], came[j + 1] = costs[pick], starts[pick]
    end, spans = n, []
    while np.isinf(best[end]):  # no cut has stretches of these lengths only: the last one is longer
        end -= 1
    rest = (end, n - 1) if end < n else None
    while end:
        spans.append((int(came[end]), end - 1))
        end = int(came[end])
    spans = spans[::-1]
    if rest:
        spans[-1:] = [(spans[-1][0], rest[1])] if spans else [(0, n - 1)]
    return spans


def spans_column(units: Column, longest: int = LONGEST, least: int = 1, tokenize: Callable[[Column], Column] = bag) -> Column:
    """array<struct<start_idx, end_idx>> of an array of units; a null array, or one without units, has none."""

    @F.pandas_udf("array<struct<start_idx:int,end_idx:int>>")
    def spans(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: [{"start_idx": a, "end_idx": b} for a, b in best_spans([list(unit) for unit in text], longest, least)])

    return spans(F.coalesce(F.transform(units, lambda u: F.coalesce(tokenize(u), F.array().cast("array<string>"))), F.array().cast("array<array<string>>")))


def cohesive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, least: int = 1, split: Callable[[Column], Column] = sentences, join: str = " ") -> DataFrame:
    """(id, pos, start_idx, end_idx, chunk): the text's units in the cheapest cut. Null and empty texts give no rows; rows are cut one by one."""
    units = docs.select(F.col(id_col), split(F.coalesce(F.col(text_col), F.lit(""))).alias("__u"))
    cut = units.select(id_col, "__u", F.posexplode(spans_column(F.col("__u"), longest, least)).alias("pos", "s"))
    return cut.select(id_col, "pos", "s.start_idx", "s.end_idx", F.array_join(F.slice("__u", F.col("s.start_idx") + 1, F.col("s.end_idx") - F.col("s.start_idx") + 1), join).alias("chunk"))


def cohesive_pages(pages: DataFrame, doc_col: str, order_col: str, text_col: str, longest: int = LONGEST, least: int = 3) -> DataFrame:
    """(doc, pos, start_idx, end_idx, chunk) as merge_pages() has it, pages of a document in the cheapest cut into chunks of at least ``least`` pages."""
    gathered = pages.groupBy(doc_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(order_col, F.coalesce(F.col(text_col), F.lit("")).alias("__t")))), lambda p: p["__t"]).alias("__u"))
    cut = gathered.select(doc_col, "__u", F.posexplode(spans_column(F.col("__u"), longest, least)).alias("pos", "s"))
    return cut.select(doc_col, "pos", "s.start_idx", "s.end_idx", F.array_join(F.slice("__u", F.col("s.start_idx") + 1, F.col("s.end_idx") - F.col("s.start_idx") + 1), "\n").alias("chunk"))
