"""Token-matching F1: each token counts its most similar one on the other side, weighted by how rare it is."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.metrics import normalise
from quern.functions.text import bag

MOST_CHARS = 3000
BLOCK = 512

#: Tokens to a matrix with a row for each.
TokenVectors = Callable[[list[str]], np.ndarray]


def letter_vectors(tokens: list[str], size: int = 16) -> np.ndarray:
    """How often each remainder of code points by ``size`` occurs: a stand-in for an encoder's token vectors."""
    found = np.zeros((len(tokens), size))
    for i, token in enumerate(tokens):
        np.add.at(found[i], [ord(c) % size for c in token], 1.0)
    return found


def clipped(text: Column) -> Column:
    """The text as this metric takes it: normalised, at most MOST_CHARS characters; null as empty."""
    return F.substring(normalise(F.coalesce(text, F.lit(""))), 1, MOST_CHARS)


def inverse_frequencies(texts: DataFrame, text_col: str, tokenize: Callable[[Column], Column] = bag) -> tuple[DataFrame, float]:
    """(token, idf): ln((texts + 1) / (texts with the token + 1)) over all rows, as the metric sees them; and what a token that none has weighs."""
    n = texts.count()
    tokens = texts.select(F.explode(F.array_distinct(tokenize(clipped(F.col(text_col))))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", F.ln((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf")), math.log(n + 1)


def _best(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The largest cosine of each row with any of the columns, by blocks of BLOCK x BLOCK."""
    best = np.full(len(rows), -np.inf)
    for i in range(0, len(rows), BLOCK):
        for j in range(0, len(columns), BLOCK):
            np.maximum(best[i : i + BLOCK], (rows[i : i + BLOCK] @ columns[j : j + BLOCK].T).max(axis=1), out=best[i : i + BLOCK])
    return best


def match_f1(reference: list[str], generated: list[str], vectors: TokenVectors, weight: dict[str, float] | None = None, unseen: float = 0.0) -> float:
    """1 if neither has a token, 0 if one has none or all weights are 0 on a side; else the harmonic mean of both sides' weighted best cosines."""
    if not reference and not generated:
        return 1.0
    if not reference or not generated:
        return 0.0
    sides = []
    for tokens in (generated, reference):
        names, counts = np.unique(np.array(tokens, dtype=object).astype(str), return_counts=True)
        found = np.asarray(vectors(names.tolist()), dtype=float)
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        sides.append((np.divide(found, norms, out=np.zeros_like(found), where=norms > 0), counts * np.array([1.0 if weight is None else weight.get(n, unseen) for n in names])))
    (g, g_weight), (r, r_weight) = sides
    if not g_weight.sum() or not r_weight.sum():
        return 0.0
    precision = float((_best(g, r) * g_weight).sum() / g_weight.sum())
    recall = float((_best(r, g) * r_weight).sum() / r_weight.sum())
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def token_match(pairs: DataFrame, id_col: str, reference: str, generated: str, vectors: TokenVectors = letter_vectors, weights: DataFrame | None = None, unseen: float = 0.0, tokenize: Callable[[Column], Column] = bag) -> DataFrame:
    """(id, f1) for every row of pairs.

    weights (token, idf): tokens without one weigh ``unseen``; without the table all weigh 1. Two empty texts score 1, one empty text 0; texts are cut to MOST_CHARS
    characters, which is the metric's own rule and bounds what a worker holds. Repeated rows give repeated results.
    """
    sides = {"r": reference, "g": generated}
    rows = pairs.select(F.col(id_col).alias("__id"), *(F.coalesce(tokenize(clipped(F.col(c))), F.array().cast("array<string>")).alias(side) for side, c in sides.items()))
    if weights is None:
        rows = rows.withColumn("w", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        tokens = rows.select("__row", F.explode(F.array_distinct(F.concat("r", "g"))).alias("token"))
        known = tokens.join(weights.select("token", "idf"), "token").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("w"))
        rows = rows.join(known, "__row", "left").withColumn("w", F.coalesce("w", F.create_map().cast("map<string,double>")))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, g, w in batches:
            yield pd.Series([match_f1(list(a), list(b), vectors, None if x is None else dict(x), unseen) for a, b, x in zip(r, g, w)], dtype=float)

    return rows.select(F.col("__id").alias(id_col), score("r", "g", "w").alias("f1"))
