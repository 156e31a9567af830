"""Evaluation metrics per row. All are columns but ROUGE-L, whose dynamic program runs in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, normalise, words
from quern.functions.vectors import cosine


def exact_match(reference: Column, generated: Column) -> Column:
    """Equal after stripping the ends and dropping blanks; inner tabs and line feeds count."""
    clean = lambda x: F.replace(normalise(x), F.lit(" "), F.lit(""))
    return (clean(reference) == clean(generated)).cast("double")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))


def _edges(n_reference: Column, n_generated: Column, score: Column) -> Column:
    return F.when((n_reference == 0) & (n_generated == 0), 1.0).when((n_reference == 0) | (n_generated == 0), 0.0).otherwise(score)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: sorted tokens, numbered among their equals, are a set."""

    def numbered(xs: Column) -> Column:
        return let(F.array_sort(xs), lambda ordered: F.transform(ordered, lambda x, i: F.concat_ws("\0", x, (i - F.array_position(ordered, x)).cast("string"))))

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def rouge1(reference: Column, generated: Column, tokenize=words) -> Column:
    a, b = tokenize(normalise(reference)), tokenize(normalise(generated))
    counts = F.struct(F.size(a).alias("a"), F.size(b).alias("b"), overlap(a, b).alias("common"))
    return let(counts, lambda n: _edges(n["a"], n["b"], f1(F.try_divide(n["common"], n["b"]), F.try_divide(n["common"], n["a"]))))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel: one big integer per row."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for token in b:
        hits = state & places.get(token, 0)
        state = ((state + hits) | (state - hits)) & full
    return len(a) - state.bit_count()


def rouge_l_score(reference: str | None, generated: str | None) -> float:
    a, b = (reference or "").split(), (generated or "").split()
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    common = lcs_length(a, b)
    precision, recall = common / len(b), common / len(a)
    return 0.0 if not common else 2 * precision * recall / (precision + recall)


def rouge_l(reference: Column, generated: Column) -> Column:
    @F.pandas_udf("double")
    def score(r: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_score(a, b) for a, b in zip(r, g)], dtype=float)

    return score(reference, generated)


def _name(d: Column) -> Column:
    return normalise(F.coalesce(F.nullif(d["filename"], F.lit("")), d["rel_path"]))


def ranked_names(gen_docs: Column) -> Column:
    """Names of retrieved documents by rank, those without one last, else in the order given."""
    placed = F.transform(F.coalesce(gen_docs, F.expr("CAST(array() AS array<struct<rank:int,filename:string,rel_path:string>>)")), lambda d, i: F.struct(F.coalesce(d["rank"].cast("long"), F.lit(10**9)).alias("r"), i.alias("i"), _name(d).alias("n")))
    return F.transform(F.array_sort(placed), lambda d: d["n"])


def _gold(ref_docs: Column) -> Column:
    return F.transform(F.coalesce(ref_docs, F.expr("CAST(array() AS array<string>)")), normalise)


def recall_hit(ref_docs: Column, gen_docs: Column) -> Column:
    """1 if any retrieved name is a gold name."""
    gold = _gold(ref_docs)
    return F.exists(ranked_names(gen_docs), lambda n: F.array_contains(gold, n)).cast("double")


def reciprocal_rank(ref_docs: Column, gen_docs: Column) -> Column:
    """1 / place of the first gold name in order of rank, or 0."""
    gold = _gold(ref_docs)
    place = F.array_position(F.transform(ranked_names(gen_docs), lambda n: F.array_contains(gold, n)), True)
    return F.when(place > 0, F.try_divide(F.lit(1.0), place)).otherwise(0.0)


def embedding_similarity(reference: Column, generated: Column, a: Column, b: Column) -> Column:
    """Cosine of two embeddings, 0 where either text is empty."""
    return F.when((normalise(reference) == "") | (normalise(generated) == ""), 0.0).otherwise(cosine(a, b))


def greedy_match_f1(a: Column, b: Column) -> Column:
    """F1 of greedy matching between token vectors: each token counts its most similar one on the other side."""

    def side(xs: Column, ys: Column) -> Column:
        best = F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y))))
        return F.try_divide(F.aggregate(best, F.lit(0.0), lambda t, s: t + s), F.size(xs))

    return _edges(F.size(a), F.size(b), f1(side(b, a), side(a, b)))
