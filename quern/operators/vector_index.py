"""An approximate index of vectors: cells around k-means centroids, residuals as product codes, exact scores for what is left.

Vectors count by direction: they are scaled to length one, so that the nearest by distance is the best by cosine. Centroids and code books are
fitted on a sample of at most SAMPLE_VALUES numbers; every vector is then put into the cell of its nearest centroid and its residual is kept as one byte
per SUB_DIMS dimensions. A search looks at the ``probes`` cells nearest to each query, scores their codes by table lookups, keeps ``refine``
times as many per query and store as are asked for, and scores those with the vectors themselves.

The work is cut into units of a slice of a cell and a block of the queries that probe it, so that a cell that holds a third of all vectors, or
one that all queries probe, is many tasks. What a unit holds at once is bounded by SLICE_ROWS, QUERY_ROWS and MAX_CELLS.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.vectors import cosine
from quern.operators.retrieval import dense_topk, merge_stores
from quern.workspace import materialize

SAMPLE_VALUES = 1 << 23
MOST_CELLS, VECTORS_PER_CELL, SUB_DIMS = 4096, 64, 4
ROUNDS, SEED = 12, 7
SLICE_ROWS, QUERY_ROWS = 8192, 1024
MAX_CELLS = 1 << 21
TUNING_QUERIES = 200


@dataclass(frozen=True)
class Codebook:
    """centroids (cells, dims); books (parts, codes, dims of a part), padded with zeros where dims are no multiple of SUB_DIMS."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each row, nearest first."""
        distance = (self.centroids**2).sum(axis=1)[None, :] - 2 * unit @ self.centroids.T
        n = min(n, len(self.centroids))
        some = np.argpartition(distance, n - 1, axis=1)[:, :n] if n < distance.shape[1] else np.tile(np.arange(n), (len(unit), 1))
        return np.take_along_axis(some, np.argsort(np.take_along_axis(distance, some, axis=1), axis=1, kind="stable"), axis=1)

    def _parts(self, values: np.ndarray) -> np.ndarray:
        width = self.books.shape[0] * SUB_DIMS
        return np.pad(values, ((0, 0), (0, width - values.shape[1]))).reshape(len(values), -1, SUB_DIMS)

    def encode(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte per part: the nearest code of the residual."""
        parts = self._parts(unit - self.centroids[cells])
        distances = (self.books**2).sum(axis=2)[None] - 2 * np.einsum("npd,pcd->npc", parts, self.books)
        return distances.argmin(axis=2).astype(np.uint8)

    def lookups(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): what each code adds to the score of each query."""
        return np.einsum("npd,pcd->npc", self._parts(queries), self.books)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, books=self.books)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Codebook:
        found = np.load(io.BytesIO(data))
        return cls(found["centroids"], found["books"])


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k centres, or as many as there are distinct points. Centres without points move to the points furthest from theirs."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        owner, far = np.empty(len(points), dtype=np.int64), np.empty(len(points))
        for at in range(0, len(points), step := max(1, MAX_CELLS // k)):
            distance = (centres**2).sum(axis=1)[None, :] - 2 * points[at : at + step] @ centres.T
            owner[at : at + step] = distance.argmin(axis=1)
            far[at : at + step] = distance.min(axis=1) + (points[at : at + step] ** 2).sum(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(owner, minlength=k)
        np.add.at(sums, owner, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def scaled(values: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros and of what is no number become nan."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return values / np.linalg.norm(values, axis=1, keepdims=True)


def fit_codebook(sample: np.ndarray, cells: int) -> Codebook:
    unit = scaled(sample.astype(float))
    unit = unit[~np.isnan(unit).any(axis=1)]
    if not len(unit):
        raise ValueError("no vector has a direction")
    centroids = k_means(unit, cells)
    plain = Codebook(centroids, np.zeros((-(-unit.shape[1] // SUB_DIMS), 1, SUB_DIMS)))
    parts = plain._parts(unit - centroids[plain.nearest(unit)[:, 0]])
    books = np.zeros((parts.shape[1], 256, SUB_DIMS))
    for p in range(parts.shape[1]):
        found = k_means(parts[:, p], 256)
        books[p, : len(found)] = found
        books[p, len(found) :] = found[0]
    return Codebook(centroids, books)


@dataclass(frozen=True)
class VectorIndex:
    """rows: cell, slice, store, doc, code, v, written down; sizes: cell, slices; codebook; probes: cells that a search looks at."""

    rows: DataFrame
    sizes: DataFrame
    codebook: Codebook
    probes: int


def _flat(vectors: DataFrame, store_col: str, doc_col: str, vector_col: str) -> DataFrame:
    found = vectors.select(F.col(store_col).cast("string").alias("store"), F.col(doc_col).cast("long").alias("doc"), F.col(vector_col).cast("array<float>").alias("v"))
    return found.where("v is not null and store is not null and doc is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def build_vector_index(vectors: DataFrame, store_col: str = "label", doc_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, probes: int | None = None, recall: float = 0.95) -> VectorIndex:
    """The index of all vectors with a store, a doc and a direction; others can be found by no cosine.

    The sample is of vectors whose hashed doc falls under a threshold, so it does not depend on partitions. Without ``probes`` they are
    doubled until TUNING_QUERIES vectors drawn the same way find ``recall`` of what exact search finds.
    """
    flat = _flat(vectors, store_col, doc_col, vector_col)
    spark = vectors.sparkSession
    first = flat.select(F.size("v").alias("dims")).first()
    if first is None:
        raise ValueError("no vectors to index")
    n, dims = flat.count(), first["dims"]
    cells = cells or int(min(MOST_CELLS, max(1, np.sqrt(n))))
    room = min(VECTORS_PER_CELL * cells, max(256, SAMPLE_VALUES // dims))
    drawn = _drawn(flat, n, room).select("v").limit(2 * room).toArrow()  # the limit is a bound on memory; the threshold draws about room
    codebook = fit_codebook(_matrix(drawn["v"].combine_chunks()), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MAX_CELLS // max(len(codebook.centroids), codebook.books.shape[0] * 256))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit = scaled(_matrix(part.column(2)))
                part, unit = part.filter(pa.array(good := ~np.isnan(unit).any(axis=1))), unit[good]
                if part.num_rows:
                    cell = codebook.nearest(unit)[:, 0]
                    codes = [row.tobytes() for row in codebook.encode(unit, cell)]
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *part.columns, pa.array(codes, pa.binary())], names=["cell", "store", "doc", "v", "code"])

    placed = flat.mapInArrow(place, "cell int, store string, doc long, v array<float>, code binary")
    rows = materialize(placed, "vector-rows")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.expr(f"cast((n + {SLICE_ROWS} - 1) div {SLICE_ROWS} as int)").alias("slices"))
    index = VectorIndex(rows, materialize(sizes, "vector-cells"), codebook, probes or 0)
    return index if probes else replace(index, probes=_enough_probes(index, n, recall))


def _drawn(flat: DataFrame, n: int, wanted: int) -> DataFrame:
    """About ``wanted`` of n rows, by a hash of their docs: copies of a vector are drawn one by one."""
    return flat.where(F.pmod(F.xxhash64("doc", "store"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, wanted / max(1, n))))


def _enough_probes(index: VectorIndex, n: int, recall: float) -> int:
    """The fewest probes, doubling, that find this share of the best five of some vectors, scores being what counts."""
    queries = materialize(_drawn(index.rows.select("store", "doc", "v"), n, TUNING_QUERIES).limit(4 * TUNING_QUERIES).select(F.monotonically_increasing_id().alias("qid"), "v"), "vector-tuning")
    args = {"store_col": "store", "doc_col": "doc", "vector_col": "v", "qid_col": "qid"}
    exact = materialize(dense_topk(index.rows.select("store", "doc", "v"), queries, **args), "vector-exact")
    least = exact.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    wanted = least.agg(F.sum("wanted")).first()[0] or 0
    probes = 1
    while probes < len(index.codebook.centroids):
        found = approximate_topk(replace(index, probes=probes), queries, qid_col="qid", vector_col="v").join(least, "qid").where(F.col("score") >= F.col("least") - 1e-9)
        if found.count() >= recall * wanted:
            break
        probes *= 2
    return min(probes, len(index.codebook.centroids))


def write_vector_index(index: VectorIndex, path: str) -> None:
    """The index as tables under path, rows in files by cell order."""
    spark = index.rows.sparkSession
    index.rows.repartitionByRange("cell", "doc").sortWithinPartitions("cell", "doc").write.mode("overwrite").parquet(f"{path}/rows")
    index.sizes.write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(index.codebook.to_bytes(), index.probes)], "codebook binary, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    model = spark.read.parquet(f"{path}/model").first()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), Codebook.from_bytes(bytes(model["codebook"])), model["probes"])


def _probed(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """(qid, v, cell) of the cells nearest to each query (qid, v)."""
    codebook, probes = index.codebook, index.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MAX_CELLS // len(codebook.centroids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit = scaled(_matrix(part.column(1)))
                part, unit = part.filter(pa.array(good := ~np.isnan(unit).any(axis=1))), unit[good]
                if part.num_rows:
                    cells = codebook.nearest(unit, probes)
                    rows = np.repeat(np.arange(part.num_rows), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in part.columns), pa.array(cells.ravel(), pa.int32())], names=["qid", "v", "cell"])

    return asked.mapInArrow(probe, "qid long, v array<float>, cell int")


def _scan(codebook: Codebook, per_store: int, in_all: int | None):
    """The best of a slice of a cell for a block of queries, by codes: so many per store, and of those so many in all. Ties go to the smaller doc."""

    def of_unit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names, types = ["qid", "store", "doc", "cell", "score"], [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64()]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        cell = rows["cell"][0].as_py()
        qids, docs = queries["qid"].to_numpy(), rows["doc"].to_numpy()
        unit = scaled(_matrix(queries["v"].combine_chunks()))
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
        base, tables = unit @ codebook.centroids[cell], codebook.lookups(unit)
        stores, store = np.unique(np.array(rows["store"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        by_store = [np.flatnonzero(store == s) for s in range(len(stores))]
        by_store = [members[np.argsort(docs[members], kind="stable")] for members in by_store]
        out: list[list] = [[], [], [], []]
        for q in range(len(qids)):
            score = base[q] + tables[q][np.arange(codes.shape[1]), codes].sum(axis=1)
            best = np.concatenate([_first(score, members, per_store) for members in by_store])
            best = best[np.lexsort((docs[best], -score[best]))[:in_all]]
            for column, values in zip(out, (np.full(len(best), qids[q]), stores[store[best]], docs[best], score[best])):
                column.append(values)
        qid, found, doc, score = (np.concatenate(c) for c in out)
        return pa.table([pa.array(qid, types[0]), pa.array(found.tolist(), types[1]), pa.array(doc, types[2]), pa.array(np.full(len(qid), cell), types[3]), pa.array(score, types[4])], names=names)

    return of_unit


def _first(score: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """The k best members, of equal ones those that come first; all that tie with the k-th are looked at."""
    if len(members) > k:
        least = -np.partition(-score[members], k - 1)[k - 1]
        members = members[score[members] >= least]
    return members[np.argsort(-score[members], kind="stable")[:k]]


def approximate_topk(index: VectorIndex, queries: DataFrame, k_each: int = 3, top_k: int | None = 5, qid_col: str = "vec_id", vector_col: str = "embedding", merge: str = "score", refine: int = 8) -> DataFrame:
    """(qid, rank, store, doc, score) as dense_topk() has it, from the cells nearest to each query. Scores are exact; documents may be missed.

    Queries without a number or a direction find nothing; every query must have a number of its own. Vectors with equal store and doc are found together.
    """
    asked = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vector_col).cast("array<float>").alias("v")).where("v is not null and qid is not null")
    probed = _probed(index, asked).join(index.sizes, "cell")
    loads = probed.groupBy("cell").agg(F.expr(f"cast((count(1) + {QUERY_ROWS} - 1) div {QUERY_ROWS} as int)").alias("blocks"))
    units = materialize(index.sizes.join(loads, "cell"), "vector-units")  # no more rows than cells
    key = ["cell", "slice", "block"]
    by_slice = probed.select("qid", "v", "cell").join(units, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    by_slice = by_slice.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*key, "qid", "v")
    rows = index.rows.select("cell", "store", "doc", "code").join(units, "cell").withColumn("slice", F.pmod(F.xxhash64("doc", "store"), F.col("slices")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "store", "doc", "code")
    per_store = refine * k_each
    in_all = None if top_k is None else per_store * -(-top_k // k_each)
    coarse = rows.groupBy(*key).cogroup(by_slice.groupBy(*key)).applyInArrow(_scan(index.codebook, per_store, in_all), "qid long, store string, doc long, cell int, score double")
    of_store = F.row_number().over(W.partitionBy("qid", "store").orderBy(F.desc("score"), "doc"))
    chosen = coarse.withColumn("__rn", of_store).where(F.col("__rn") <= per_store)
    if in_all is not None:
        first = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc", "store"))
        chosen = chosen.withColumn("__rn", first).where(F.col("__rn") <= in_all)
    chosen = chosen.select("qid", "store", "doc", "cell").distinct()
    vectors = index.rows.select("cell", "store", "doc", F.col("v").alias("__v"))
    exact = chosen.join(vectors, ["cell", "store", "doc"]).join(asked.withColumnRenamed("v", "__q"), "qid").withColumn("score", cosine(F.col("__v"), F.col("__q")))
    order = F.row_number().over(W.partitionBy("qid", "store").orderBy(F.desc(F.round("score", 12)), "doc"))
    best = exact.withColumn("rn", order).where(F.col("rn") <= k_each).select("qid", "store", "rn", "doc", "score")
    return merge_stores(best, top_k, merge)
