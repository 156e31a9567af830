"""A BM25 index that grows: immutable segments, deletions as bitmaps, counts of documents per term as sums of changes, merges.

An addition is a segment: the rows of its documents, numbered, and what they add to the counts of terms and to the sizes of stores. A deletion
is bitmaps over the numbers of rows, per segment and bucket, and what it takes from those counts. The index that a search reads is the union of the segments without the
rows whose bits are set, with the sums of all counts, so it finds what an index built anew would. Manifests name what is there (see manifests).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import bag
from quern.operators.retrieval import LexicalIndex, lexical_rows, lexical_stats, store_sizes, term_counts
from quern.sources.manifests import ManifestLog
from quern.workspace import discard, materialize


class Overtaken(RuntimeError):
    """Another writer deleted or merged meanwhile."""


class GrowingIndex:
    """The index at a path. Stores and documents are columns of ``docs`` given to add(); (store, doc) names a document."""

    def __init__(self, spark: SparkSession, path: str, store_col: str = "source", doc_col: str = "doc_id", text_col: str = "text", tokenize: Callable[[Column], Column] = bag):
        self.spark, self.columns, self.tokenize = spark, (store_col, doc_col, text_col), tokenize
        self.log = ManifestLog(spark, path)

    # -- writing

    def _write_segment(self, rows: DataFrame) -> str:
        folder = self.log.new_folder("segment")
        rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
        written = self.spark.read.parquet(f"{folder}/rows")
        term_counts(written).write.parquet(f"{folder}/terms")
        store_sizes(written).write.parquet(f"{folder}/sizes")
        return folder

    def add(self, docs: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Documents that are not in the index yet, as one segment: only they are tokenized. A batch of a source that came before changes nothing."""

        def done(manifest: dict) -> bool:
            return source is not None and batch is not None and batch <= manifest.get("batches", {}).get(source, -1)

        version, newest = self.log.latest()
        if done(newest):
            return version
        folder = self._write_segment(lexical_rows(docs, *self.columns, self.tokenize))

        def append(number: int, now: dict) -> dict | None:
            if done(now):
                return None
            batches = now.get("batches", {}) | ({source: batch} if source is not None and batch is not None else {})
            return {"kind": "add", "segments": [*now.get("segments", []), folder], "deletions": now.get("deletions", []), "batches": batches}

        return self.log.commit(append)

    def delete(self, keys: DataFrame, tries: int = 5) -> int:
        """Take out the documents of (store, doc). Those that are not there do no harm."""
        wanted = keys.select(F.col("store").alias("__store"), F.col("doc").alias("__doc")).distinct()
        for _ in range(tries):
            version, manifest = self.log.latest()
            if not version:
                return version
            hit = self._rows(manifest).join(wanted, F.col("store").eqNullSafe(F.col("__store")) & F.col("doc").eqNullSafe(F.col("__doc")), "left_semi")
            hit = materialize(hit, "lexical-hits")
            folder = self.log.new_folder("deletion")
            bits = hit.groupBy("segment", F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
            bits.write.parquet(f"{folder}/bits")
            hit.select("segment", "store", F.explode("terms").alias("term")).groupBy("segment", "store", "term").agg((-F.count(F.lit(1))).alias("df")).write.parquet(f"{folder}/terms")
            sizes = hit.groupBy("segment", "store").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("length")).alias("total_length"))
            sizes.write.parquet(f"{folder}/sizes")
            discard(hit)
            try:
                return self.log.commit(self._unless_overtaken(manifest, lambda now: now | {"kind": "delete", "deletions": [*now["deletions"], folder]}))
            except Overtaken:
                continue
        raise Overtaken(f"{tries} times while deleting at {self.log.path}")

    @staticmethod
    def _unless_overtaken(seen: dict, change: Callable[[dict], dict]) -> Callable[[int, dict], dict]:
        """Additions may come meanwhile; deletions and merges may not, as counts were taken from what was seen."""

        def checked(number: int, now: dict) -> dict:
            if now["deletions"] != seen["deletions"] or now["segments"][: len(seen["segments"])] != seen["segments"]:
                raise Overtaken
            return change(now)

        return checked

    def merge(self, most_docs: int | None = None) -> int:
        """Write the segments of at most so many documents (all, without a number) as one, without what was deleted."""
        version, manifest = self.log.latest()
        if not version:
            return version
        sizes = {folder: self.spark.read.parquet(f"{folder}/sizes").agg(F.sum("n_docs")).first()[0] or 0 for folder in manifest["segments"]}
        small = [folder for folder, n in sizes.items() if most_docs is None or n <= most_docs]
        if len(small) + len(manifest["deletions"]) < 2:
            return version
        rows = self._rows(manifest | {"segments": small})
        folder = self._write_segment(rows.drop("segment", "at"))
        kept = [s for s in manifest["segments"] if s not in small]

        def swap(now: dict) -> dict:
            added = now["segments"][len(manifest["segments"]) :]
            return now | {"kind": "merge", "segments": [*kept, folder, *added], "deletions": now["deletions"] if kept else []}

        return self.log.commit(self._unless_overtaken(manifest, swap))

    # -- reading

    def _parts(self, folders: list[str], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{folder}/{name}").withColumn("segment", F.lit(folder.rsplit("/", 1)[-1])) for folder in folders])

    def _taken(self, manifest: dict, name: str) -> DataFrame:
        """What deletions say of the segments that are there."""
        found = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{folder}/{name}") for folder in manifest["deletions"]])
        return found.where(F.col("segment").isin([folder.rsplit("/", 1)[-1] for folder in manifest["segments"]]))

    def _rows(self, manifest: dict) -> DataFrame:
        """store, doc, length, terms, tfs, at, segment of the documents that are there."""
        rows = self._parts(manifest["segments"], "rows")
        if not manifest["deletions"]:
            return rows
        bits = self._taken(manifest, "bits").groupBy("segment", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        marked = rows.withColumn("bucket", F.expr("bitmap_bucket_number(at)")).join(bits, ["segment", "bucket"], "left")
        byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as int)"
        return marked.where(F.expr(f"bits is null or shiftright({byte}, cast(bitmap_bit_position(at) % 8 as int)) % 2 = 0")).select(*rows.columns)

    def index(self, version: int | None = None) -> LexicalIndex:
        """What a search reads, as of a version. Only the counts are added up and written; rows stay where they are."""
        version = self.log.latest()[0] if version is None else version
        if not version:
            raise ValueError("nothing was added yet")
        manifest = self.log.read(version)
        terms, sizes = self._parts(manifest["segments"], "terms"), self._parts(manifest["segments"], "sizes")
        if manifest["deletions"]:
            terms, sizes = terms.unionByName(self._taken(manifest, "terms")), sizes.unionByName(self._taken(manifest, "sizes"))
        terms = materialize(terms.groupBy("store", "term").agg(F.sum("df").alias("df")).where("df > 0"), "lexical-terms")
        sizes = sizes.groupBy("store").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_length").alias("total_length")).where("n_docs > 0")
        return LexicalIndex(self._rows(manifest).select("store", "doc", "length", "terms", "tfs"), materialize(lexical_stats(sizes, terms), "lexical-stats"), terms)

    def vacuum(self, keep: int = 2) -> list[str]:
        return self.log.vacuum(keep, lambda m: [*m["segments"], *m["deletions"]])
