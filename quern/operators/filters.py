"""Row filters and set operations of the pipelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let, lines_kept, sentences, strip, words
from quern.functions.vectors import argmax
from quern.workspace import materialize

CLASSES = ("entailment", "neutral", "contradiction")


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(F.length(strip(F.coalesce(F.col(text_col), F.lit("")))) > 0)


class FilteredPages:
    """Results of a costly filter by key, written down once: flows over the same pages ask a model only the first time."""

    def __init__(self, keep: Callable[[DataFrame], DataFrame]):
        self.keep, self.known = keep, {}

    def of(self, key: str, pages: DataFrame) -> DataFrame:
        if key not in self.known:
            self.known[key] = materialize(self.keep(pages), "filtered-pages")
        return self.known[key]


def looks_useful(text: Column, min_words: int = 5, max_repeats: int = 10, max_symbols: float = 0.5) -> Column:
    """A deterministic stand-in for a usefulness model: no mere title, no sentence repeated ten times, not mostly symbols or unreadable."""
    again = lambda ordered: F.transform(ordered, lambda s, i: F.get(ordered, i + (max_repeats - 1)) == s)
    repeated = F.exists(let(F.array_sort(sentences(text)), again), lambda same: F.coalesce(same, F.lit(False)))
    size = F.length(text)
    symbols = size - F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return (F.size(words(text)) >= min_words) & ~repeated & (symbols <= max_symbols * size)


def trim_to_header(text: Column, headers: Sequence[str]) -> Column:
    """The text from the first line on that is one of the headers but for white space at its ends, as it stands; null if there is none. Lines end at any line break."""
    lines = lines_kept(text)
    known = F.array(*(F.lit(h) for h in headers))
    at = F.array_position(F.transform(lines, lambda line: F.array_contains(known, strip(line))), True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), ""))


def rounded(score: Column, digits: int = 4) -> Column:
    return F.round(score, digits)


def reaches(score: Column, threshold: float) -> Column:
    """Whether a score, rounded to four decimals first, reaches a threshold; never for null or NaN."""
    return F.coalesce(~F.isnan(score) & (rounded(score) >= threshold), F.lit(False))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(selected, rejected): together all rows."""
    return df.where(F.coalesce(condition, F.lit(False))), df.where(~F.coalesce(condition, F.lit(False)))


def nli_premises(strategy: str) -> tuple[Column, Column]:
    """(premise, hypothesis): "CD" chunk with its summary against the declarative, "QA" question against answer."""
    if strategy == "CD":
        return F.concat_ws(" ", F.nullif(F.col("md_summary"), F.lit("")), F.nullif(F.col("raw_chunk"), F.lit(""))), F.coalesce(F.col("declarative"), F.lit(""))
    if strategy == "QA":
        return F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))
    raise ValueError(f"unknown strategy {strategy}")


def nli_keep(strategy: str, threshold: float) -> Column:
    """Chunk and declarative must entail; question and answer must be neutral."""
    return reaches(F.col({"CD": "score_entailment", "QA": "score_neutral"}[strategy]), threshold)


def nli_class(scores: Column) -> Column:
    """Name of the largest of (entailment, neutral, contradiction), before any rounding; the first of equal ones."""
    return F.element_at(F.array(*(F.lit(c) for c in CLASSES)), argmax(scores) + 1)


def null_safe_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose key is in right, nulls equal to nulls; left's duplicates stay."""
    other = right.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"__{k}"])
        condition = same if condition is None else condition & same
    return left.join(other, condition, "left_semi")


def limit_first(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def pick_keys(m: Column, keys: Sequence[str]) -> Column:
    """A map with these keys only; all of them if none are named."""
    return F.map_filter(m, lambda k, _: F.array_contains(F.array(*(F.lit(x) for x in keys)), k)) if keys else m


def long_enough(a: Column, b: Column, n: int) -> Column:
    return (F.length(a) >= n) & (F.length(b) >= n)
