"""The approximate index against exact search: recall, skewed cells, copies, edges, reopening."""

import numpy as np
import pytest
from quern.operators import vector_index as vi
from quern.operators.retrieval import dense_topk

SCHEMA = "vec_id long, embedding array<float>, label string, cell string, score string"


def frame(spark, vectors, labels=None):
    rows = [(i, None if v is None else [float(x) for x in v], str(i % 3) if labels is None else labels[i], "c", "s") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def recall(found, exact):
    """By score: of vectors that are as good any may be found."""
    least, n = {}, {}
    for r in exact.collect():
        least[r["qid"]] = min(r["score"], least.get(r["qid"], 9))
        n[r["qid"]] = n.get(r["qid"], 0) + 1
    hits = sum(r["score"] >= least[r["qid"]] - 1e-6 for r in found.collect())
    return hits / sum(n.values())


def clustered(n, dims, seed):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(30, dims))[draw.integers(0, 30, n)] + 0.6 * draw.normal(size=(n, dims))


@pytest.mark.parametrize("dims", [16, 30])
def test_recall(spark, dims):
    vectors = frame(spark, clustered(3000, dims, dims))
    queries = vectors.where("vec_id % 20 = 0")
    index = vi.build_vector_index(vectors)
    assert index.rows.count() == 3000 and index.probes < len(index.codebook.centroids)
    found, exact = vi.approximate_topk(index, queries), dense_topk(vectors, queries)
    assert recall(found, exact) >= 0.9
    scores = {(r["qid"], r["doc"]): r["score"] for r in exact.collect()}
    assert all(abs(scores[r["qid"], r["doc"]] - r["score"]) < 1e-9 for r in found.collect() if (r["qid"], r["doc"]) in scores)


def test_recall_of_vectors_without_clusters(spark):
    draw = np.random.default_rng(2)
    vectors = frame(spark, draw.normal(size=(1500, 24)))
    queries = vectors.where("vec_id % 20 = 0")
    assert recall(vi.approximate_topk(vi.build_vector_index(vectors), queries), dense_topk(vectors, queries)) >= 0.9


def test_given_data_reaches_the_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    assert recall(vi.approximate_topk(vi.build_vector_index(vectors), queries), dense_topk(vectors, queries)) >= 0.9


def test_all_cells_and_all_candidates_are_exact(spark, monkeypatch):
    """Small slices and blocks, so that one cell is many units; equal scores go to the smaller number."""
    monkeypatch.setattr(vi, "SLICE_ROWS", 40)
    monkeypatch.setattr(vi, "QUERY_ROWS", 8)
    points = clustered(400, 8, 5)
    points[100:250] = points[7]
    vectors = frame(spark, points)
    index = vi.build_vector_index(vectors, cells=6, probes=6)
    queries = vectors.where("vec_id % 4 = 0")
    found = sorted(map(tuple, vi.approximate_topk(index, queries, refine=20, k_each=20, top_k=None).collect()))
    wanted = sorted(map(tuple, dense_topk(vectors, queries, k_each=20, top_k=None).collect()))
    assert [(*r[:2], round(r[4], 6)) for r in found] == [(*r[:2], round(r[4], 6)) for r in wanted]
    hot = [r for r in found if r[0] == 100 and r[4] > 1 - 1e-9]
    assert sorted(r[3] for r in hot) == sorted([i for i in [7, *range(100, 250)] if i % 3 == s][j] for s in range(3) for j in range(20))


def test_edges(spark):
    """Null vectors, stores and numbers, vectors without a direction, one vector only, queries that find nothing."""
    vectors = frame(spark, [[1.0, 0.0, 2.0], None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [2.0, 1.0, 0.0], [1.0, 1.0, 1.0]], ["a", "a", "a", "a", None, "b"])
    index = vi.build_vector_index(vectors)
    assert sorted(r["doc"] for r in index.rows.collect()) == [0, 5]
    assert {(r["qid"], r["doc"]) for r in vi.approximate_topk(index, vectors).collect()} == {(q, d) for q in (0, 4, 5) for d in (0, 5)}
    assert vi.approximate_topk(index, vectors.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vi.build_vector_index(vectors.limit(0))


def test_reopened(spark, tmp_path):
    vectors = frame(spark, clustered(300, 12, 9))
    index = vi.build_vector_index(vectors, probes=3)
    vi.write_vector_index(index, f"{tmp_path}/index")
    opened = vi.open_vector_index(spark, f"{tmp_path}/index")
    queries = vectors.where("vec_id % 20 = 0")
    assert opened.probes == 3 and np.array_equal(opened.codebook.centroids, index.codebook.centroids)
    assert sorted(map(tuple, vi.approximate_topk(opened, queries).collect())) == sorted(map(tuple, vi.approximate_topk(index, queries).collect()))


def test_k_means_of_few_points():
    assert sorted(vi.k_means(np.array([[1.0], [1.0], [5.0]]), 8).ravel().tolist()) == [1.0, 5.0]
