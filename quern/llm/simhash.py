"""SimHash near-duplicate classes, found with Golay-code fuzzy hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two
fingerprints link when they differ in at most ``max_distance`` bits (k). The 64 bits are cut into k + 1
segments. Going round the segments, some segment is equal in both fingerprints while the next one
differs in at most one bit: if each equal segment were followed by one with two errors or more,
the errors would outnumber k. A key is therefore an exact segment plus the name of a Golay codeword
near the next segment; linked fingerprints always share such a key.

Only distinct fingerprints get keys, so exact copies cost nothing. Keys held by at most
``bucket_limit`` fingerprints are joined and their pairs verified. Fingerprints of fuller buckets take an
exact way whose rows grow with the bucket and not with its square: those within k bits have a point in between,
so each lists the points around it and links to the smallest fingerprint that stands next to the point.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.golay import near_indices
from quern.workspace import discard, materialize

HASH_SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        values = np.array([hash_of(s, HASH_SEED) for s in shingles[at : at + CHUNK]], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp long) for every row of docs. Null texts count as empty."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(of_batches, "id long, fp long")


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(shift, width) of max_distance + 1 segments that cover 64 bits, none wider than a Golay word."""
    n = max_distance + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def golay_keys(values: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of unsigned 64-bit fingerprints."""
    segments = _segments(max_distance)
    rows, keys = [], []
    for i, (shift, width) in enumerate(segments):
        next_shift, next_width = segments[(i + 1) % len(segments)]
        exact = (values >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        row, index = near_indices((values >> np.uint64(next_shift) & np.uint64((1 << next_width) - 1)).astype(np.int64))
        rows.append(row)
        keys.append((np.int64(i) << np.int64(40)) | (exact[row] << np.int64(12)) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame, max_distance: int) -> DataFrame:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = golay_keys(values.view(np.uint64), max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(of_batches, "key long, fp long")


def _ball(radius: int) -> list[int]:
    """All 64-bit masks of at most radius bits, signed."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _dense_links(crowded: DataFrame, max_distance: int) -> DataFrame:
    """All links among the fingerprints given, as edges to one fingerprint next to a point they share.

    near points lie within floor(k/2) bits of a fingerprint, far ones within ceil(k/2). At one point, near
    fingerprints are within k bits of one another and of far ones.
    """
    near, far = _ball(max_distance // 2), _ball(max_distance - max_distance // 2)

    def around(masks: list[int], names: tuple[str, str]) -> DataFrame:
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flips = np.array(masks, dtype=np.int64)
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, len(values), 256):
                    part = values[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips)))], names=list(names))

        return crowded.select("fp").mapInArrow(of_batches, f"{names[0]} long, {names[1]} long")

    hub = around(near, ("point", "fp")).groupBy("point").agg(F.min("fp").alias("dst"))
    return around(far, ("point", "src")).join(hub, "point").where("src <> dst").select("src", "dst")


def fingerprint_links(distinct: DataFrame, max_distance: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(src, dst): links of fingerprints at most max_distance bits apart, enough of them to keep all that are connected connected."""
    if not 1 <= max_distance <= 6:
        raise ValueError("max_distance must be from 1 to 6")
    if max_distance == 1:
        return _dense_links(distinct, 1)
    keyed = materialize(_keyed(distinct, max_distance), "simhash-keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "simhash-sizes")  # a written side lets a crowded key be split
    shared = materialize(keyed.join(sizes, "key"), "simhash-shared")
    left = shared.where(F.col("size") <= bucket_limit).select("key", F.col("fp").alias("src"))
    right = left.select("key", F.col("src").alias("dst"))
    apart = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    verified = left.join(right, "key").where((F.col("src") < F.col("dst")) & (apart <= max_distance)).select("src", "dst")
    crowded = shared.where(F.col("size") > bucket_limit).select("fp").distinct()
    return verified.union(_dense_links(crowded, max_distance)).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_distance: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(id, fp, component_id, n_copies) for every row of docs.

    component_id is the smallest id that chains of links reach from the row, itself included; n_copies is the
    number of other rows with the same fingerprint. Null ids form part of classes but never name one:
    component_id is null only where a class has no other id. Repeated ids give repeated rows.
    An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(distinct, "simhash-distinct")
    return named_classes(prints, distinct, fingerprint_links(distinct, max_distance, bucket_limit))


def named_classes(prints: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(id, fp, component_id, n_copies) of prints (id, fp), from distinct (fp, first_id, copies) and links (src, dst) of fp."""
    components = connected_components(links)
    joined = distinct.join(components.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = materialize(joined, "simhash-components")
    discard(components)
    names = materialize(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-names")  # a giant component is split, too
    named = joined.join(names, "component").select("fp", "component_id", F.col("copies") - 1)
    named = materialize(named.toDF("fp", "component_id", "n_copies"), "simhash-named")
    discard(joined, names)
    return prints.join(named, "fp").select("id", "fp", "component_id", "n_copies")


def keep_one_per_class(docs: DataFrame, shingle_words: int = 5, max_distance: int = 2, bucket_limit: int = 64) -> DataFrame:
    """The rows of docs that name their class: one document of every near-duplicate class, with all its columns.

    Five-word shingles; fingerprints at most two bits of 64 apart stand for shingle sets far more than 0.8 alike. Rows that
    share a doc_id count as one document and stay together if any of them names its class. Rows without a doc_id stay.
    """
    classes = near_duplicate_classes(docs, "doc_id", "text", shingle_words, max_distance, bucket_limit)
    return keep_named(docs, classes)


def keep_named(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names its class, and those without one."""
    names_class = F.col("id") == F.col("component_id")
    dropped = classes.where("id is not null").groupBy("id").agg(F.bool_or(names_class).alias("stays")).where(~F.col("stays")).select(F.col("id").alias("__dropped"))
    return docs.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
