"""A table of keyed rows in versions: upserts, deletions, reading as of a version, compaction, batches that count once.

Every change is a folder of rows, ``__seq`` being the version that wrote them and ``__deleted`` marking tombstones; a manifest lists the
folders, so a change that fails half way is never seen and what is being read is never overwritten. Reading resolves the changes since the last compaction
against the base: rows of the base whose keys no change has pass through unshuffled where the changes are few enough to be broadcast by size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.manifests import ManifestLog

SEQ, DELETED = "__seq", "__deleted"


class VersionedTable:
    """keys name a row. Of rows with equal keys the one with the largest ``order`` counts, of equal ones the one written last; without ``order`` the last.

    A deletion removes what its keys held at its version, whatever their order; rows written later are not touched by it. Null keys equal each other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None):
        self.spark, self.keys, self.order = spark, list(keys), order
        self.log = ManifestLog(spark, path)

    # -- writing

    def upsert(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Rows of the same keys within one call are resolved by order and then by their values. The version after it."""
        values = F.struct(*([self.order] if self.order else []), *[c for c in rows.columns if c != self.order])
        newest = rows.groupBy(*self.keys).agg(F.max(values).alias("__row")) if _orderable(rows) else self._any(rows)
        return self._change(newest.select("__row.*").select(*rows.columns).withColumn(DELETED, F.lit(False)), "upsert", source, batch)

    def _any(self, rows: DataFrame) -> DataFrame:
        """Rows with maps in them have no order of their own; one of those that come last by ``order`` counts."""
        whole = F.struct(*rows.columns)
        return rows.groupBy(*self.keys).agg((F.max_by(whole, F.col(self.order)) if self.order else F.first(whole)).alias("__row"))

    def delete(self, keys: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Remove the rows of these keys; keys that are not there do no harm. The version after it."""
        version, manifest = self.log.latest()
        if not version:
            raise ValueError("there is no table to delete from")
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        gone = keys.select(*self.keys).distinct()
        filled = gone.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return self._change(filled.withColumn(DELETED, F.lit(True)), "delete", source, batch)

    def _done(self, manifest: dict, source: str | None, batch: int | None) -> bool:
        return source is not None and batch is not None and batch <= manifest.get("batches", {}).get(source, -1)

    def _change(self, rows: DataFrame, kind: str, source: str | None, batch: int | None) -> int:
        version, newest = self.log.latest()
        if self._done(newest, source, batch):
            return version
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != DELETED)
        if newest and newest["schema"] != schema:
            raise ValueError(f"the table has {newest['schema']}, the rows have {schema}")
        folder = self.log.new_folder(kind)
        rows.write.parquet(folder)

        def append(number: int, now: dict) -> dict | None:
            if self._done(now, source, batch):
                return None
            batches = now.get("batches", {}) | ({source: batch} if source is not None and batch is not None else {})
            return {"kind": kind, "schema": schema, "base": now.get("base"), "changes": [*now.get("changes", []), [folder, number]], "batches": batches}

        return self.log.commit(append)

    def writer(self, source: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that comes again, as after a failure, changes nothing."""
        return lambda rows, batch: self.upsert(rows, source, batch) and None

    # -- reading

    def _folders(self, folders: list[list], schema: str) -> DataFrame:
        found = self.spark.createDataFrame([], f"{schema}, {DELETED} boolean, {SEQ} long")
        for folder, number in folders:
            found = found.unionByName(self.spark.read.schema(f"{schema}, {DELETED} boolean").parquet(folder).withColumn(SEQ, F.lit(number).cast("long")))
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the newest by default."""
        version = self.log.latest()[0] if version is None else version
        if not version:
            raise ValueError("there is no table yet")
        manifest = self.log.read(version)
        return self._resolved(manifest).drop(SEQ)

    def _resolved(self, manifest: dict) -> DataFrame:
        schema = manifest["schema"]
        changes = self._folders(manifest["changes"], schema)
        if manifest["base"] is None:
            return self._newest(changes)
        base = self.spark.read.schema(f"{schema}, {SEQ} long").parquet(manifest["base"])
        if not manifest["changes"]:
            return base
        touched = changes.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        met = base.join(touched, same, "left_semi").withColumn(DELETED, F.lit(False))
        return base.join(touched, same, "left_anti").unionByName(self._newest(changes.unionByName(met)))

    def _newest(self, rows: DataFrame) -> DataFrame:
        of_key = W.partitionBy(*self.keys)
        gone = F.max(F.when(F.col(DELETED), F.col(SEQ))).over(of_key)
        alive = rows.withColumn("__gone", gone).where(f"not {DELETED} and {SEQ} > coalesce(__gone, -1)")
        ranked = alive.withColumn("__rn", F.row_number().over(of_key.orderBy(*([F.desc(self.order)] if self.order else []), F.desc(SEQ))))
        return ranked.where("__rn = 1").drop("__rn", "__gone", DELETED)

    def history(self) -> list[tuple[int, str]]:
        """(version, kind of change) from the oldest that is kept."""
        return [(number, self.log.read(number)["kind"]) for number in self.log.versions()]

    # -- keeping

    def compact(self) -> int:
        """Write the newest version as a new base. Changes that come meanwhile stay changes; of two compactions at once one counts."""
        version, manifest = self.log.latest()
        if not version or not manifest["changes"]:
            return version
        folder = self.log.new_folder("base")
        self._resolved(manifest).write.parquet(folder)
        covered = {change[0] for change in manifest["changes"]}

        def swap(number: int, now: dict) -> dict | None:
            if now["base"] != manifest["base"]:
                return None
            return now | {"kind": "compact", "base": folder, "changes": [change for change in now["changes"] if change[0] not in covered]}

        return self.log.commit(swap)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all versions but the newest ones, and folders that only those needed or that no version has."""
        return self.log.vacuum(keep, lambda m: [*([m["base"]] if m["base"] else []), *(change[0] for change in m["changes"])])


def _orderable(rows: DataFrame) -> bool:
    return "map<" not in rows.schema.simpleString() and "variant" not in rows.schema.simpleString()
