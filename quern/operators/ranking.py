"""A learned order of candidates: boosted trees fitted to nDCG (LambdaMART), scored as SQL expressions.

Features of a question and a candidate are lexical (BM25 score and rank, shares of the question's words, neighbouring words and words at most two apart that the document
has in that order), positional (where the first of them stands) and of vectors (cosine of text embeddings). Trees are fitted on the driver to a
bounded sample of judged questions; every other step runs on columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import models
from quern.functions.text import bag
from quern.functions.vectors import cosine

N_TREES, DEPTH, RATE, MIN_LEAF, CUTS, DAMPING = 40, 3, 0.15, 10, 32, 1.0
FEATURES = ("bm25", "place", "words", "pairs", "near", "first", "length", "vector")
#: Questions that a ranker is fitted on, at most.
MOST_QUESTIONS = 2000

#: A leaf, or (feature, threshold, where at most, where more).
Tree = float | tuple


def _joined(tokens: str, gap: int) -> str:
    """SQL for the pairs of tokens that stand ``gap`` apart."""
    return f"transform(filter(sequence(0, size({tokens}) - 1), i -> i + {gap} < size({tokens})), i -> concat_ws(' ', get({tokens}, i), get({tokens}, i + {gap})))"


def with_features(found: DataFrame, questions: DataFrame, contents: DataFrame, tokenize: Callable[[Column], Column] = bag, embed: Callable[[Column], Column] = models.hashed_embedding) -> DataFrame:
    """found (qid, rank, doc, score) with FEATURES. questions: qid, question; contents: doc, content. Null texts count as empty, missing ones drop the row."""
    asked = questions.select("qid", F.coalesce("question", F.lit("")).alias("__question"))
    held = contents.join(found.select("doc").distinct(), "doc", "left_semi").select("doc", F.coalesce("content", F.lit("")).alias("__content"))
    rows = found.join(asked, "qid").join(held, "doc").withColumn("__q", tokenize(F.col("__question"))).withColumn("__d", tokenize(F.col("__content")))
    some = "size({0}) > 0 and size({1}) > 0"
    share = lambda a, b: F.expr(f"if({some.format(a, b)}, size(array_intersect({a}, {b})) / size(array_distinct({a})), 0.0D)")
    empty = "cast(array() as array<string>)"
    for name, gaps in (("p", (1,)), ("n", (1, 2))):
        for side in "qd":
            listed = ", ".join(_joined(f"__{side}", gap) for gap in gaps)
            rows = rows.withColumn(f"__{name}{side}", F.expr(f"if(size(__{side}) > 1, concat({listed}), {empty})"))
    first = F.expr("if(size(__d) > 0, coalesce(array_min(transform(array_intersect(__q, __d), t -> array_position(__d, t))) / size(__d), 1.0D), 1.0D)")
    similar = F.coalesce(F.nanvl(cosine(embed(F.col("__question")), embed(F.col("__content"))), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("bm25", F.col("score")).withColumn("place", F.col("rank").cast("double")).withColumn("words", share("__q", "__d")).withColumn("pairs", share("__pq", "__pd")).withColumn("near", share("__nq", "__nd"))
    rows = rows.withColumn("first", first).withColumn("length", F.log1p(F.size("__d"))).withColumn("vector", similar)
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def dcg(gains: np.ndarray) -> float:
    return float(((2.0**gains - 1) / np.log2(np.arange(2, len(gains) + 2))).sum())


def ndcg(labels: np.ndarray, scores: np.ndarray, k: int = 10) -> float:
    """nDCG at k of one question; ties keep their order. 0 without a relevant candidate."""
    best = dcg(np.sort(labels)[::-1][:k])
    return dcg(labels[np.argsort(-scores, kind="stable")][:k]) / best if best else 0.0


def _pulls(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and curvatures of one question's candidates: for each pair that differs in label, what swapping it changes in nDCG times how wrong its order is."""
    slope, curve = np.zeros(len(labels)), np.zeros(len(labels))
    best = dcg(np.sort(labels)[::-1])
    if not best:
        return slope, curve
    place = np.empty(len(labels))
    place[np.argsort(-scores, kind="stable")] = np.arange(len(labels))
    discount = 1 / np.log2(place + 2)
    higher, lower = np.nonzero(labels[:, None] > labels[None, :])
    weight = np.abs((2.0 ** labels[higher] - 2.0 ** labels[lower]) * (discount[higher] - discount[lower])) / best
    wrong = 1 / (1 + np.exp(np.clip(scores[higher] - scores[lower], -50, 50)))
    np.add.at(slope, higher, weight * wrong)
    np.add.at(slope, lower, -weight * wrong)
    for side in (higher, lower):
        np.add.at(curve, side, weight * wrong * (1 - wrong))
    return slope, curve


def _grow(x: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, names: tuple[str, ...], out: np.ndarray) -> Tree:
    def worth(part: np.ndarray) -> float:
        return slope[part].sum() ** 2 / (curve[part].sum() + DAMPING)

    best, chosen = 1e-9, None
    if depth:
        for f, thresholds in enumerate(cuts):
            for threshold in thresholds:
                left = x[rows, f] <= threshold
                if MIN_LEAF <= left.sum() <= len(rows) - MIN_LEAF and (gain := worth(rows[left]) + worth(rows[~left]) - worth(rows)) > best:
                    best, chosen = gain, (f, float(threshold), left)
    if chosen is None:
        leaf = float(round(RATE * slope[rows].sum() / (curve[rows].sum() + DAMPING), 9))
        out[rows] += leaf
        return leaf
    f, threshold, left = chosen
    return names[f], threshold, _grow(x, cuts, slope, curve, rows[left], depth - 1, names, out), _grow(x, cuts, slope, curve, rows[~left], depth - 1, names, out)


def fit_trees(x: np.ndarray, labels: np.ndarray, qids: np.ndarray, names: tuple[str, ...] = FEATURES, n_trees: int = N_TREES) -> list[Tree]:
    """Trees whose sum orders candidates (rows of x) of each question by label."""
    groups = [np.flatnonzero(qids == q) for q in np.unique(qids)]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    scores, trees = np.zeros(len(x)), []
    for _ in range(n_trees):
        slope, curve = np.zeros(len(x)), np.zeros(len(x))
        for rows in groups:
            slope[rows], curve[rows] = _pulls(labels[rows], scores[rows])
        trees.append(_grow(x, cuts, slope, curve, np.arange(len(x)), DEPTH, names, scores))
    return trees


def trees_sql(trees: list[Tree]) -> str:
    """The trees' sum as SQL over the features' columns."""

    def walk(node: Tree) -> str:
        if isinstance(node, tuple):
            name, threshold, left, right = node
            return f"if({name} <= {threshold!r}D, {walk(left)}, {walk(right)})"
        return f"{node!r}D"

    return " + ".join(walk(tree) for tree in trees) or "0.0D"


@dataclass(frozen=True)
class Ranker:
    trees: list[Tree]

    def score(self) -> Column:
        return F.expr(trees_sql(self.trees))

    def rerank(self, featured: DataFrame, top_k: int | None = None) -> DataFrame:
        """featured with ``rerank_score`` and ``rank`` anew by it; of equal ones the one that ranked first stays first."""
        scored = featured.withColumnRenamed("rank", "__old").withColumn("rerank_score", self.score())
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rerank_score"), "__old"))).drop("__old")
        return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def fit_ranker(judged: DataFrame, most_questions: int = MOST_QUESTIONS) -> Ranker:
    """A ranker from (qid, label 0 or more, FEATURES). Of more questions than most_questions those with the smallest hashes are taken, so the driver holds their candidates only."""
    taken = judged.select("qid").distinct().orderBy(F.xxhash64("qid"), "qid").limit(most_questions)
    rows = judged.join(taken, "qid").select("qid", F.col("label").cast("double"), *FEATURES).orderBy("qid", "place").toPandas()
    return Ranker(fit_trees(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), rows["qid"].to_numpy()) if len(rows) else [])


def planted_questions(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", words: int = 14) -> DataFrame:
    """(qid, question): a stretch of a document's words with every third or so left out, qid being the document's id, for about ``most`` documents drawn by their hashes."""
    n = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, n))))
    tokens = drawn.select(F.col(id_col).cast("long").alias("qid"), bag(F.col(text_col)).alias("t")).where(F.size("t") >= 2 * words)
    begin = F.pmod(F.xxhash64("qid", F.lit(1)), (F.size("t") - words).cast("long")).cast("int")
    kept = F.filter(F.slice("t", begin + 1, F.lit(words)), lambda w, i: F.pmod(F.xxhash64("qid", i), F.lit(3)) > 0)
    return tokens.select("qid", F.array_join(kept, " ").alias("question"))
