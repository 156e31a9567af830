"""Writers. File names of the record layouts are columns; a directory per group is a partition of the write."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import group_of
from quern.operators.retrieval import LexicalIndex, upsert
from quern.operators.records import running_ids
from quern.sources.files import open_output
from quern.workspace import materialize


def write_vectors(rows: DataFrame, path: str, old: DataFrame | None = None) -> None:
    """Upsert vectors keyed by (store, rel_path): with the old table, which may be read from path, the newest version of each stays.

    The new table is written beside the path and takes its place when it is whole. versions.VersionedTable has upserts with a history.
    """
    merged = rows if old is None else upsert(old.unionByName(rows), ["store", "rel_path"], "version")
    beside, before = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    merged.write.partitionBy("store").parquet(beside)
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    here, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, before))
    fs = here.getFileSystem(conf)
    if fs.exists(here) and not fs.rename(here, gone):
        raise OSError(f"{path} cannot be moved aside; the new table is at {beside}")
    if not fs.rename(new, here):
        raise OSError(f"{beside} cannot be moved to {path}; the old table is at {before}")
    fs.delete(gone, True)


def write_lexical(index: LexicalIndex, path: str) -> None:
    """The tables of an index, as open_lexical() of scans reads them."""
    for name in ("rows", "stats", "terms"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def chunk_records(chunks: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Chunk records with ids from 1 in order, and the file name each would have."""
    numbered = running_ids(chunks, order, 1, "id")
    return numbered.withColumn("tag", F.lit(tag)).withColumn("file_name", F.format_string("%s_%03d.json", F.lit(tag), F.col("id")))


def write_records(rows: DataFrame, path: str, group: str | None = None) -> None:
    """JSON lines, null fields left out, in a folder per group."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(group) if group else writer).json(path, ignoreNullFields=True)


def group_folder(rows: DataFrame, folders: DataFrame, name: str = "chunk_name") -> DataFrame:
    """rows with ``folder``: that of the first chunk file, by name, that begins with the row's name less its last part; "." if there is none.

    folders has (stem, folder). The theta join becomes one on the prefix: all prefixes of a stem that end before an underscore or at its end are candidates.
    """
    prefix = F.regexp_replace(F.col(name), r"_[^_]*$", "")
    known = folders.select("stem", "folder", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.substring("stem", 1, n))).alias("__p"))
    wanted = rows.select(prefix.alias("__p")).distinct()
    firsts = known.join(wanted, "__p", "left_semi").groupBy("__p").agg(F.min_by("folder", F.struct("stem", "folder")).alias("folder"))
    return rows.withColumn("__p", prefix).join(firsts, "__p", "left").withColumn("folder", F.coalesce("folder", F.lit("."))).drop("__p")


def write_trimmed(pages: DataFrame, path: str) -> None:
    """Markdown in a folder per document: the stem without its page number."""
    pages.withColumn("group", group_of(F.col("stem"))).select("group", "text").write.mode("overwrite").partitionBy("group").text(path)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """One file per row of rows (rel_path, text) under folder, written by the tasks. Returns the manifest (path, n_bytes) when all are written.

    A task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes = [], []
            for rel_path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = (text or "").encode("utf-8", "surrogatepass")
                with open_output(f"{folder}/{rel_path}") as out:
                    out.write(content)
                paths.append(f"{folder}/{rel_path}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return materialize(rows.select("rel_path", "text").mapInArrow(write, "path string, n_bytes long"), "files-manifest")


def prose_files(pages: DataFrame) -> DataFrame:
    """(rel_path, text, source_file) of pages (rel_path, prose): "<folder>/<stem>_prose.md" beside where the source stood; blank ones go."""
    kept = pages.where(F.length(F.trim(F.coalesce("prose", F.lit("")))) > 0)
    return kept.select(F.regexp_replace("rel_path", r"\.[^./]*$", "_prose.md").alias("rel_path"), F.trim("prose").alias("text"), F.element_at(F.split("rel_path", "/"), -1).alias("source_file"))


def metric_rows(scored: DataFrame, results: DataFrame, metric: str, fields: Sequence[str] = ("reference", "generated")) -> DataFrame:
    """The rows of a metric's file: its score beside the fields it was taken from."""
    return scored.select("id", metric).join(results.select("id", *fields), "id").select(metric, "id", *fields)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; for small results."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def summary_sheets(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(averages, deviations): one row each, a column per metric."""
    sheet = lambda value: summary.groupBy().pivot("metric").agg(F.first(value))
    return sheet("average"), sheet("std")
