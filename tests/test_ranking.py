"""The learned order against BM25 on held-out questions, trees as SQL against trees by hand, features by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.operators import ranking, retrieval


def walk(node, row):
    while isinstance(node, tuple):
        name, threshold, left, right = node
        node = left if row[name] <= threshold else right
    return node


def test_held_out_questions_rank_better_than_by_bm25(spark):
    """Fragments of documents, fitted on half of the questions and measured on the others; relevant is the document a fragment is from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = retrieval.lexical_index(docs.withColumn("source", F.lit("all")))
    questions = ranking.planted_questions(docs, 500).cache()
    found = retrieval.lexical_topk(index, questions, 20, 20, "score", qid_col="qid", text_col="question")
    rows = ranking.with_features(found, questions, docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")))
    rows = rows.withColumn("label", (F.col("doc") == F.col("qid")).cast("int")).cache()
    ranker = ranking.fit_ranker(rows.where("qid % 2 = 0"))
    held = rows.where("qid % 2 = 1").withColumn("learned", ranker.score()).orderBy("qid", "rank").toPandas()
    names = list(ranking.FEATURES)
    assert np.allclose(held["learned"], [sum(walk(t, dict(zip(names, r))) for t in ranker.trees) for r in held[names].itertuples(index=False)])
    mean = {s: np.mean([ranking.ndcg(g["label"].to_numpy(float), g[s].to_numpy(float)) for _, g in held.groupby("qid")]) for s in ("score", "learned")}
    print(mean)
    assert held["qid"].nunique() > 100 and mean["learned"] > mean["score"] + 0.005
    best = ranker.rerank(rows, 1).toPandas()
    assert (best["rank"] == 1).all() and best["qid"].is_unique


def test_features(spark):
    found = spark.createDataFrame([(1, 1, 7, 2.0), (1, 2, 8, 1.0), (1, 3, 9, 0.5), (2, 1, 7, 0.0), (3, 1, 404, 1.0)], "qid long, rank int, doc long, score double")
    questions = spark.createDataFrame([(1, "red green blue"), (2, None), (3, "x")], "qid long, question string")
    contents = spark.createDataFrame([(7, "a red green blue"), (8, "blue then green and red"), (9, None)], "doc long, content string")
    rows = {(r["qid"], r["doc"]): r for r in ranking.with_features(found, questions, contents).collect()}
    assert set(rows) == {(1, 7), (1, 8), (1, 9), (2, 7)}
    shown = lambda key: tuple(round(rows[key][c], 6) for c in ("words", "pairs", "near", "first"))
    assert shown((1, 7)) == (1, 1, 1, 0.5) and shown((1, 8)) == (1, 0, 0, 0.2) and shown((1, 9)) == (0, 0, 0, 1) and shown((2, 7)) == (0, 0, 0, 1)
    assert abs(rows[1, 7]["length"] - np.log(5)) < 1e-12 and rows[1, 9]["vector"] == 0


def test_trees_learn_an_order_no_single_feature_has():
    draw = np.random.default_rng(1)
    x = draw.random((1500, len(ranking.FEATURES)))
    labels = ((x[:, 2] > 0.5) != (x[:, 3] > 0.5)).astype(float)
    qids = np.repeat(np.arange(150), 10)
    trees = ranking.fit_trees(x, labels, qids)
    scores = np.array([sum(walk(t, dict(zip(ranking.FEATURES, row))) for t in trees) for row in x])
    kept = [q for q in range(150) if labels[qids == q].any()]
    assert np.mean([ranking.ndcg(labels[qids == q], scores[qids == q]) for q in kept]) > 0.97
    assert ranking.trees_sql([]) == "0.0D" and ranking.trees_sql([("bm25", 0.5, 1.0, ("first", 2.0, -1.0, 3.0))]) == "if(bm25 <= 0.5D, 1.0D, if(first <= 2.0D, -1.0D, 3.0D))"


@pytest.mark.parametrize("labels, want", [([0, 0], 0.0), ([1, 0], 1.0), ([0, 1], 1 / np.log2(3))])
def test_ndcg(labels, want):
    assert abs(ranking.ndcg(np.array(labels, float), np.array([2.0, 1.0])) - want) < 1e-12
