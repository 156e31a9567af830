"""Readers of the pipelines' files: explicit schemas, order columns instead of file order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import natural_key, stem
from quern.operators.filters import drop_blank
from quern.operators.records import running_ids
from quern.operators.retrieval import LexicalIndex
from quern.sources.files import open_input
from quern.workspace import fresh_path, shared_dir

READ_BYTES = 8 << 20  # of whole files that a batch of rows holds, and one file more

CHUNK = "id long, source_files array<string>, md_summary string, raw_chunk string"
QA = "id long, chunk_name string, source_files array<string>, raw_chunk string, md_summary string, question string, answer string, declarative string, ref_doc string, options array<string>"
PREDICTION = "id long, question string, generated string, answer string, agent string, ref_doc string, retrieved array<struct<rel_path:string,rank:int,content:array<string>>>, judge_score array<map<string,double>>"


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist; missing sources are skipped."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append(path)
    return found


def relative(path, root: str):
    return F.regexp_replace(path, rf"^.*?\Q{root.rstrip('/')}\E/", "")


def markdown_pages(spark: SparkSession, paths: Sequence[str], glob: str = "*.md") -> DataFrame:
    """(path, rel_path, stem, text, sort_key) of markdown files in files and folders, blank ones left out. Order by sort_key, path for natural order."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, rel_path string, stem string, text string, sort_key array<string>")
    rows = spark.read.text(found, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rel = F.col("path")
    for root in found:
        rel = F.when(F.contains(F.col("path"), F.lit(root.rstrip("/") + "/")), relative(F.col("path"), root)).otherwise(rel)
    return drop_blank(rows.select("path", rel.alias("rel_path"), stem(F.col("path")).alias("stem"), "text")).withColumn("sort_key", natural_key(F.col("stem")))


def written_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """As markdown_pages(), of the files that a manifest (path) of sinks.write_files() names: tasks open them by name, and no one lists the folder.

    A name that was written several times is one file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with open_input(path) as stream:
                    contents.append(stream.read())
                paths.append(path)
                held += len(contents[-1])
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    rows = manifest.select("path").distinct().mapInArrow(read, "path string, content binary")
    rel = F.substring(F.col("path"), len(folder) + 2, 1 << 30)
    pages = rows.select("path", rel.alias("rel_path"), stem(F.col("path")).alias("stem"), F.col("content").cast("string").alias("text"))
    return drop_blank(pages).withColumn("sort_key", natural_key(F.col("stem")))


def index_rows(pages: DataFrame) -> DataFrame:
    """Metadata of pages for an index: filename, source, rel_path, type, text."""
    return pages.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("source"), "rel_path", F.lit("md").alias("type"), "text")


def chunk_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Chunk records with blank ones left out, and metadata for an index: chunk_id, original_id, source_files as text."""
    rows = spark.read.schema(CHUNK).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter=glob).select("*", F.col("_metadata.file_path").alias("path"))
    kept = drop_blank(rows, "raw_chunk")
    return kept.select("*", F.concat(stem(F.col("path")), F.lit("__c001")).alias("chunk_id"), F.col("id").cast("string").alias("original_id"), F.array_join(F.coalesce("source_files", F.array().cast("array<string>")), ", ").alias("source_list"))


def qa_files(spark: SparkSession, path: str) -> DataFrame:
    """Question records of files that hold an object or an array each, with ``id`` anew from 0 in order of path and place; files that cannot be read as either have none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"))
    placed = files.select("path", F.posexplode(F.from_json("value", f"array<struct<{QA.replace(' ', ': ').replace(',:', ',')}>>")).alias("__at", "r"))
    return renumber(placed.select("r.*", "path", "__at").where("question is not null"), ["path", "__at"]).drop("__at")


def renumber(rows: DataFrame, order: list[str]) -> DataFrame:
    return running_ids(rows.drop("id"), order, 0, "id")


def prediction_files(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records with ``result_file``; order by coalesce(id, 0)."""
    return spark.read.schema(PREDICTION).json(path, multiLine=True, recursiveFileLookup=True).select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), *[c.split()[0] for c in ("question", "generated", "answer", "agent", "ref_doc", "retrieved", "judge_score")], F.col("_metadata.file_name").alias("result_file"))


def score_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("setting string, qid string, bertscore double, sbert double, rouge1 double, rougeL double").csv(path, header=True)


def decoded_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of files read as UTF-8, bytes that are none left out."""
    raw = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter=glob)

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return raw.select("path", decode("content").alias("text"))


def rendered_pages(spark: SparkSession, path: str, render: Callable[[bytes, int], Iterator[tuple[int, str, bytes]]], dpi: int = 300, glob: str = "*.pdf") -> DataFrame:
    """(path, page_no, part, image): a renderer, called per file with its bytes and resolution, yields numbered page images."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                for number, part, image in render(bytes(content), dpi):
                    yield pd.DataFrame({"path": [source], "page_no": [number], "part": [part], "image": [image]})

    raw = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter=glob).select("path", "content")
    return raw.mapInPandas(pages, "path string, page_no int, part string, image binary")


def recognized_text(pages: DataFrame, recognize: Callable[[bytes], tuple[str, str]]) -> DataFrame:
    """(path, page_no, markdown, layout): text recognition per page image, batch by batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [recognize(bytes(i)) for i in batch["image"]]
            yield batch[["path", "page_no"]].assign(markdown=[m for m, _ in found], layout=[x for _, x in found])

    return pages.select("path", "page_no", "image").mapInPandas(read, "path string, page_no int, markdown string, layout string")


def open_stores(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """An index table partitioned by store, and the names of its stores."""
    table = spark.read.parquet(path)
    return table, sorted(r["store"] for r in table.select("store").distinct().collect())


#: Part of the name of stored indexes: changes with what they hold.
LEXICAL_FORMAT = 1


def fingerprint(files: DataFrame) -> str:
    """A number for the files that a table reads: their paths, sizes and times. Only their footers are read."""
    meta = files.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    found = meta.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.expr("bit_xor(xxhash64(h))").alias("y")).first()
    return f"{found['n']}-{(found['x'] or 0) & (1 << 64) - 1:016x}{(found['y'] or 0) & (1 << 64) - 1:016x}"


def stored_lexical(files: DataFrame, name: str, build: Callable[[str], LexicalIndex]) -> LexicalIndex:
    """The index ``name`` of a table of files, opened if it was built for these files before, else built by build(folder).

    It is written beside its place and moved there whole, so that one half written is never opened; of two that build at once one counts.
    """
    spark = files.sparkSession
    place = f"{shared_dir(spark)}/lexical-index-{LEXICAL_FORMAT}-{name}-{fingerprint(files)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        beside = fresh_path(spark, "lexical")
        build(beside)
        made = spark._jvm.org.apache.hadoop.fs.Path(beside)
        if fs.exists(path) or not fs.rename(made, path):
            fs.delete(made, True)
    return open_lexical(spark, place)


def open_lexical(spark: SparkSession, path: str) -> LexicalIndex:
    """A BM25 index that write_lexical() wrote: searches read its tables and tokenize nothing but questions."""
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "stats", "terms")))
