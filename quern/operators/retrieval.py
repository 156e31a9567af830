"""Lexical (BM25) and dense indexes as tables, and top-k search over many stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import bag
from quern.workspace import fresh_path, materialize

K1, B, FLOOR = 1.5, 0.75, 0.25
MAX_QUERY_BYTES = 64 << 20  # a block of questions, sent to every task
MAX_CELLS = 1 << 21  # scores that a worker holds at once


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of a BM25 index, written once and read by every search.

    rows: store, doc, length, terms (distinct, sorted), tfs (how often each stands in the document); stats: store, n_docs, avg_length, floor; terms: store, term, df.
    """

    rows: DataFrame
    stats: DataFrame
    terms: DataFrame

    @property
    def docs(self) -> DataFrame:
        return self.rows.select("store", "doc", "length")

    def postings(self) -> DataFrame:
        """store, doc, length, term, tf."""
        return self.rows.select("store", "doc", "length", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5))


def lexical_index(docs: DataFrame, store_col: str = "source", doc_col: str = "doc_id", text_col: str = "text", tokenize: Callable[[Column], Column] = bag, folder: str | None = None) -> LexicalIndex:
    """Statistics are of each store by itself. ``floor`` is what terms with a negative idf get: a share of the mean idf of the store's vocabulary.

    Texts are tokenized once; a null text has no terms. Document frequencies are counted before they are shuffled. The tables are written to
    ``folder``, or to one of their own under the shared folder.
    """
    folder = folder or fresh_path(docs.sparkSession, "lexical")
    rows = materialize(lexical_rows(docs, store_col, doc_col, text_col, tokenize), "", f"{folder}/rows")
    terms = materialize(term_counts(rows), "", f"{folder}/terms")
    return LexicalIndex(rows, materialize(lexical_stats(store_sizes(rows), terms), "", f"{folder}/stats"), terms)


def lexical_rows(docs: DataFrame, store_col: str = "source", doc_col: str = "doc_id", text_col: str = "text", tokenize: Callable[[Column], Column] = bag) -> DataFrame:
    """(store, doc, length, terms, tfs) of every document."""
    tokens = docs.select(F.col(store_col).alias("store"), F.col(doc_col).alias("doc"), F.sort_array(F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>"))).alias("t"))
    starts = "IF(size(t) = 0, CAST(array() AS array<int>), filter(sequence(0, greatest(size(t) - 1, 0)), i -> i = 0 OR get(t, i) <> get(t, i - 1)))"
    placed = tokens.select("store", "doc", "t", F.expr(starts).alias("s"))
    return placed.select("store", "doc", F.size("t").cast("long").alias("length"), F.expr("transform(s, i -> get(t, i))").alias("terms"), F.expr("transform(s, (p, k) -> coalesce(get(s, k + 1), size(t)) - p)").alias("tfs"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(store, term, df)."""
    return rows.select("store", F.explode("terms").alias("term")).groupBy("store", "term").agg(F.count(F.lit(1)).alias("df"))


def store_sizes(rows: DataFrame) -> DataFrame:
    """(store, n_docs, total_length)."""
    return rows.groupBy("store").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("total_length"))


def lexical_stats(sizes: DataFrame, terms: DataFrame) -> DataFrame:
    """(store, n_docs, avg_length, floor)."""
    sized = sizes.select("store", "n_docs", (F.col("total_length") / F.col("n_docs")).alias("avg_length"))
    floors = terms.join(sized, "store").groupBy("store").agg((FLOOR * F.avg(idf(F.col("n_docs"), F.col("df")))).alias("floor"))
    return sized.join(floors, "store", "left")


def _weights(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """(store, number, idf) of the terms wanted (term, number)."""
    raw = idf(F.col("n_docs"), F.col("df"))
    return index.terms.join(wanted, "term").join(index.stats, "store").select("store", "number", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))


def _best_places(scores: np.ndarray, tie: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best of some rows for every column: highest score first, then smallest tie."""
    order = np.lexsort((np.broadcast_to(tie[members][:, None], (len(members), scores.shape[1])), -scores[members]), axis=0)[:k]
    return members[order]


def _members(stores: list) -> dict:
    found: dict = {}
    for i, store in enumerate(stores):
        found.setdefault(store, []).append(i)
    return {store: np.array(rows) for store, rows in found.items()}


def _summed(n_rows: int, n_questions: int, owner: np.ndarray, number: np.ndarray, gains: np.ndarray, begins: np.ndarray, asked_by: np.ndarray, asked_times: np.ndarray) -> np.ndarray:
    """Scores (rows, questions) from hits (owner: row, number: term, gain), each added to the questions that have the term: those between its begins."""
    scores = np.zeros(n_rows * n_questions)
    fans = begins[number + 1] - begins[number]
    upto = np.cumsum(fans)
    at = 0
    while at < len(fans):  # as many hits as fan out to MAX_CELLS additions, one at least
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MAX_CELLS, side="right")))
        fan = fans[at:end]
        hit = np.repeat(np.arange(at, end), fan)
        place = np.arange(len(hit)) - np.repeat(np.cumsum(fan) - fan, fan) + begins[number[hit]]
        np.add.at(scores, owner[hit] * n_questions + asked_by[place], gains[hit] * asked_times[place])
        at = end
    return scores.reshape(n_rows, n_questions)


def _lexical_block(index: LexicalIndex, block: list, stores: dict, k_each: int) -> DataFrame:
    """(qid, store, doc, score) candidates of one block of questions [(qid, terms)]: one pass over the index, no shuffle."""
    qids = [q for q, _ in block]
    numbers: dict[str, int] = {}
    for _, terms in block:
        for term in terms:
            numbers.setdefault(term, len(numbers))
    asks = sorted((numbers[term], q, terms.count(term)) for q, (_, terms) in enumerate(block) for term in set(terms))
    asked_by, asked_times = np.array([q for _, q, _ in asks], dtype=np.int64), np.array([n for *_, n in asks], dtype=float)
    begins = np.searchsorted(np.array([number for number, *_ in asks], dtype=np.int64), np.arange(len(numbers) + 1))
    spark = index.rows.sparkSession
    weights = np.zeros((len(stores), len(numbers)))
    wanted = spark.createDataFrame(list(numbers.items()), "term string, number int")
    for r in _weights(index, wanted).toLocalIterator():
        weights[stores[r["store"]][0], r["number"]] = r["idf"]
    vocabulary = pa.array(list(numbers), pa.string())
    types = {f.name: f.dataType for f in index.rows.schema}
    step = max(1, MAX_CELLS // max(1, len(qids)))

    def of_part(part: pa.RecordBatch) -> pa.RecordBatch:
        names, docs = part.column(0).to_pylist(), part.column(1).to_pylist()
        lists = part.column(3)
        found = pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        hit = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), dtype=bool)
        owner, number, tf = owner[hit], found[hit].astype(np.int64), part.column(4).flatten().to_numpy(zero_copy_only=False)[hit].astype(float)
        place = np.array([stores[s][0] for s in names], dtype=np.int64)
        share = part.column(2).to_numpy(zero_copy_only=False) / np.array([stores[s][1] or 1.0 for s in names])
        gains = weights[place[owner], number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share[owner]))
        scores = _summed(part.num_rows, len(qids), owner, number, gains, begins, asked_by, asked_times)
        scores = np.round(scores, 9) + 0.0
        tie = -np.unique(np.array(docs), return_inverse=True)[1]
        out_stores, out_docs, values, asks = [], [], [], []
        for store, members in _members(names).items():
            best = _best_places(scores, tie, members, k_each)
            out_stores += [store] * best.size
            out_docs += [docs[i] for i in best.ravel().tolist()]
            values.append(np.take_along_axis(scores, best, axis=0).ravel())
            asks += qids * len(best)
        return pa.RecordBatch.from_arrays([pa.array(asks, pa.int64()), pa.array(out_stores, part.schema.field(0).type), pa.array(out_docs, part.schema.field(1).type), pa.array(np.concatenate(values))], names=["qid", "store", "doc", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield of_part(batch.slice(at, step))

    return index.rows.where("store is not null").mapInArrow(search, f"qid long, store {types['store'].simpleString()}, doc {types['doc'].simpleString()}, score double")


def _top(blocks: Iterator, search: Callable[[Any], DataFrame], k_each: int, label: str, *order: Column) -> DataFrame | None:
    """(qid, store, rn, doc, score): k_each of each question and store. Of several blocks each is searched and its result written before the next one is made."""

    def best(block: Any) -> DataFrame:
        return search(block).withColumn("rn", F.row_number().over(W.partitionBy("qid", "store").orderBy(*order))).where(F.col("rn") <= k_each)

    done: list[DataFrame] = []
    waiting = next(blocks, None)
    if waiting is None:
        return None
    for block in blocks:
        done.append(materialize(best(waiting), label))
        waiting = block
    return best(waiting) if not done else reduce(DataFrame.unionByName, [*done, materialize(best(waiting), label)])


def _question_blocks(asked: DataFrame, n_stores: int, max_query_bytes: int) -> Iterator[list]:
    """Lists of (qid, terms), as many questions as keep terms times (questions + stores) within max_query_bytes."""
    block, held = [], set()
    for row in asked.toLocalIterator():
        more = held | set(row["terms"])
        if block and len(more) * (len(block) + 1 + n_stores) * 8 > max_query_bytes:
            yield block
            block, more = [], set(row["terms"])
        if len(more) * (1 + n_stores) * 8 > max_query_bytes:
            raise ValueError(f"one question's {len(more)} terms in {n_stores} stores exceed max_query_bytes")
        block.append((row["qid"], row["terms"]))
        held = more
    if block:
        yield block


def lexical_topk(index: LexicalIndex, questions: DataFrame, k_each: int = 4, top_k: int | None = 5, merge: str = "concat", qid_col: str = "item_id", text_col: str = "text", tokenize: Callable[[Column], Column] = bag, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(qid, rank, store, doc, score): k_each per store, then stores one after the other ("concat") or by score ("score"), cut at top_k.

    A term counts as often as a question has it; documents without any of its terms score 0 and fill stores with few others. Scores
    that agree to nine decimals tie, and ties go to the larger doc.

    Search runs in blocks of questions, as many as keep terms times (questions + stores) within max_query_bytes. For a block every task gets the
    weights of its terms in each store, and one pass over the index gives k_each candidates per question, store and batch.
    """
    asked = questions.select(F.col(qid_col).cast("long").alias("qid"), F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("terms")).where("qid is not null")
    stores = {r["store"]: (i, r["avg_length"]) for i, r in enumerate(index.stats.where("store is not null").select("store", "avg_length").toLocalIterator())}
    blocks = _question_blocks(asked, len(stores), max_query_bytes)
    best = _top(blocks, lambda block: _lexical_block(index, block, stores, k_each), k_each, "lexical-block", F.desc("score"), F.desc("doc"))
    if best is None:
        best = _top(iter([[]]), lambda block: _lexical_block(index, block, stores, k_each), k_each, "lexical-block", F.desc("score"), F.desc("doc"))
    return merge_stores(best, top_k, merge)


def merge_stores(best: DataFrame, top_k: int | None, merge: str) -> DataFrame:
    """(qid, rank, store, doc, score) from (qid, store, rn, doc, score). "concat" keeps the order of stores by name, "score" sorts all by score and leaves ties in that order."""
    order = [F.col("store"), F.col("rn")] if merge == "concat" else [F.desc("score"), F.col("store"), F.col("rn")]
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "store", "doc", "score")


class _Nearest:
    """The candidates of a task: of each query and store the k_each best, and of those, where top_k is given, no other than can be among the top_k best of all stores.

    A row of another task can push one out of its store's k_each only by a better score, so what is behind top_k rows here is behind as many everywhere.
    """

    def __init__(self, n_queries: int, k_each: int, top_k: int | None):
        self.n_queries, self.k_each, self.top_k = n_queries, k_each, top_k
        self.floor = np.full(n_queries, -np.inf)  # what a score must reach
        self.stores: dict[Any, int] = {}
        self.parts: list[np.ndarray] = []  # query, store, doc, score
        self.fresh, self.kept = 0, 0

    def add(self, stores: list, docs: np.ndarray, scores: np.ndarray) -> None:
        """Scores (rows, queries) of some rows; none where a score is NaN."""
        codes = np.array([self.stores.setdefault(s, len(self.stores)) for s in stores], dtype=np.int64)
        row, query = np.nonzero(scores >= self.floor)
        self.parts.append(np.rec.fromarrays([query, codes[row], docs[row], scores[row, query]], names="query,store,doc,score"))
        self.fresh += len(row)
        if self.fresh > max(self.kept, MAX_CELLS // 16):
            self.compact()

    def compact(self) -> None:
        found = np.concatenate(self.parts)
        rounded = np.round(found["score"], 12)
        order = np.lexsort((found["doc"], -rounded, found["store"], found["query"]))
        found, rounded = found[order], rounded[order]
        kept = _places_in_runs(found["query"], found["store"]) < self.k_each
        found, rounded = found[kept], rounded[kept]
        if self.top_k is not None:
            order = np.lexsort((-rounded, found["query"]))
            found, rounded = found[order], rounded[order]
            last = _places_in_runs(found["query"]) == self.top_k - 1
            self.floor[found["query"][last]] = rounded[last] - 1e-11  # ties and what rounding may tie stay
            found = found[found["score"] >= self.floor[found["query"]]]
        self.parts, self.fresh, self.kept = [found], 0, len(found)

    def batches(self, qids: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(qid, store, doc, score) of all that is kept, which is forgotten."""
        if not self.parts:
            return
        self.compact()
        found, names = self.parts[0], pa.array(list(self.stores), kind)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(qids[part["query"]], pa.int64()), names.take(pa.array(part["store"])), pa.array(part["doc"], pa.int64()), pa.array(part["score"], pa.float64())], names=["qid", "store", "doc", "score"])
        self.parts, self.kept = [], 0


def _places_in_runs(*keys: np.ndarray) -> np.ndarray:
    """The place of every row in its run of equal keys."""
    n = len(keys[0])
    begins = np.zeros(n, dtype=np.int64)
    if n:
        begins[1:] = np.where(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), np.arange(1, n), 0)
    return np.arange(n) - np.maximum.accumulate(begins)


def _dense_block(flat: DataFrame, qids: np.ndarray, matrix: np.ndarray, k_each: int, best_of_all: int | None = None) -> DataFrame:
    """(qid, store, doc, score) candidates of one block of queries. best_of_all: how many by score over all stores are wanted, if not all."""
    with np.errstate(invalid="ignore", divide="ignore"):
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    step = max(1, MAX_CELLS // max(1, len(qids)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(len(qids), k_each, best_of_all)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = values @ matrix.T / np.linalg.norm(values, axis=1, keepdims=True)
                nearest.add(part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False), scores)
                if nearest.kept > 2 * MAX_CELLS:
                    yield from nearest.batches(qids, pa.string())
        yield from nearest.batches(qids, pa.string())

    # Every task has candidates of its own: as many tasks as run at a time give no more than the cluster needs, however large the table is.
    return flat.coalesce(2 * flat.sparkSession.sparkContext.defaultParallelism).mapInArrow(search, "qid long, store string, doc long, score double")


def dense_topk(vectors: DataFrame, queries: DataFrame, k_each: int = 3, top_k: int | None = 5, store_col: str = "label", doc_col: str = "vec_id", vector_col: str = "embedding", qid_col: str = "vec_id", merge: str = "score", max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(qid, rank, store, doc, score): cosine similarity, k_each per store, then top_k by score. Ties go to the smaller doc.

    Exact search in blocks: as many queries as max_query_bytes holds go to every task as one matrix, with which its vectors are
    multiplied slice by slice. A task gives at most k_each candidates per query and store, by score only those that can be among top_k, so what is
    shuffled does not grow with the vectors. A query set of any size is searched, one pass over the vectors per block.
    """
    asked = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(vector_col).alias("v")).where("v is not null and qid is not null")
    flat = vectors.where(F.col(vector_col).isNotNull()).select(F.col(store_col).cast("string").alias("store"), F.col(doc_col).cast("long").alias("doc"), F.col(vector_col).cast("array<float>").alias("v"))
    best = _top(_vector_blocks(asked, max_query_bytes), lambda block: _dense_block(flat, *block, k_each, top_k if merge == "score" else None), k_each, "dense-block", F.desc(F.round("score", 12)), F.col("doc"))
    if best is None:
        best = flat.selectExpr("doc AS qid", "store", "CAST(0 AS int) AS rn", "doc", "CAST(0 AS double) AS score").where("false")
    return merge_stores(best, top_k, merge)


def _vector_blocks(asked: DataFrame, max_query_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) of as many queries as max_query_bytes holds."""
    qids, values = [], []
    for row in asked.toLocalIterator():
        if qids and (len(qids) + 1) * len(row["v"]) * 8 > max_query_bytes:
            yield np.array(qids, dtype=np.int64), np.array(values, dtype=float)
            qids, values = [], []
        qids.append(row["qid"])
        values.append(row["v"])
    if qids:
        yield np.array(qids, dtype=np.int64), np.array(values, dtype=float)


def upsert(table: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))
    return table.withColumn("__rn", newest).where("__rn = 1").drop("__rn")


def gather_context(found: DataFrame, contents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", questions: DataFrame | None = None) -> DataFrame:
    """(qid, context, docs): contents of the retrieved documents in order of rank, joined by blank lines; empty and missing ones are left out.

    With ``questions`` (qid), those for which nothing was found have an empty context and no documents.
    """
    joined = found.join(contents.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("content")), "doc", "left")
    parts = F.array_sort(F.collect_list(F.struct("rank", "doc", "content")))
    texts = F.filter(F.transform(parts, lambda p: F.nullif(p["content"], F.lit(""))), lambda t: t.isNotNull())
    gathered = joined.groupBy("qid").agg(F.array_join(texts, "\n\n").alias("context"), F.transform(parts, lambda p: p["doc"]).alias("docs"))
    if questions is None:
        return gathered
    none = F.array().cast(gathered.schema["docs"].dataType)
    return questions.select("qid").join(gathered, "qid", "left").select("qid", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("docs", none).alias("docs"))


def with_readings(context: Column, **sections: Column) -> Column:
    """A context with named sections behind it, those that are empty left out."""
    tagged = [F.concat(F.lit(f"[{name}]\n"), F.nullif(value, F.lit(""))) for name, value in sections.items()]
    return F.concat_ws("\n\n", F.nullif(context, F.lit("")), *tagged)
