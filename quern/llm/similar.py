"""Near-duplicate texts by the Jaccard similarity of their word shingles: exact, and without fingerprints unless they are asked for as well.

1. Texts with the same words form a class by themselves (a 64-bit key); only distinct ones are compared.
2. Texts with similarity of SIMILARITY (4/5) or more miss at most a fifth of one another's shingles. A text for which more than a fifth of all its
   shingles are, already among those with small hashes, in no other text has no partner and is left out.
3. Shingles of the others are ordered from rare to common. Of a similar pair, the text with fewer shingles misses at most a ninth of its
   own, the other a fifth, so both have their first common shingle in so long a prefix (+ 1) and meet there.
4. Every text of a shingle is first compared with one text of it, the one with the fewest shingles of its own; pairs which that connects are
   not formed. All others are, and their similarity is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.simhash import keep_named, named_classes, near_duplicate_classes
from quern.workspace import discard, materialize

SHARE = 77  # of 256: shingles whose hashes end in less are looked at first


def shingle_hashes(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, ASCII case and white space aside; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    hash_of = xxhash.xxh3_64_intdigest
    return np.array(list({hash_of(s) for s in shingles}), dtype=np.uint64).view(np.int64)


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text): fp is a key of the text's words. Null texts count as empty."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()) for t in batch.column(1)]
            keys = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), batch.column(1)], names=["id", "fp", "text"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(of_batches, "id long, fp long, text string")


def _shingle_rows(texts: DataFrame, shingle_words: int, share: int | None) -> DataFrame:
    """(shingle, fp, n): one row for every distinct shingle of a text, or for those whose hashes end in less than share."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                hashes = [shingle_hashes(t.as_py(), shingle_words) for t in part.column(1)]
                shown = hashes if share is None else [h[(h & 255) < share] for h in hashes]
                sizes = [len(h) for h in shown]
                columns = [np.concatenate(shown), np.repeat(keys, sizes), np.repeat(np.array([len(h) for h in hashes], dtype=np.int32), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "fp", "n"])

    return texts.select("fp", "text").mapInArrow(of_batches, "shingle long, fp long, n int")


def _held(rows: DataFrame) -> DataFrame:
    """Shingles that at least two texts hold, and how many do."""
    return materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "similar-held")


def _lonely(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(fp) of the texts that have no partner: too many of the shingles looked at first are in no other text."""
    rows = materialize(_shingle_rows(texts, shingle_words, SHARE), "similar-first")
    held = _held(rows)
    shared = rows.join(held, "shingle").groupBy("fp").agg(F.count(F.lit(1)).alias("shared"))
    seen = rows.groupBy("fp").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("seen"))
    lonely = seen.join(shared, "fp", "left").where(F.col("seen") - F.coalesce("shared", F.lit(0)) > F.floor(F.col("n") / 5)).select("fp")
    lonely = materialize(lonely, "similar-lonely")
    discard(rows, held)
    return lonely


def _prefixes(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(shingle, fp, n, own, place, is_index): the first fifth of a text's shingles from rare to common, less the own ones, which no other text holds.

    place: how many of the text's shingles come before.
    """
    ranked = rows.join(held, "shingle").groupBy("fp").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("shared"))  # bounded by a text's own shingles
    ranked = ranked.withColumn("own", F.col("n") - F.size("shared")).where(F.col("own") <= F.floor(F.col("n") / 5))
    first = F.slice("shared", 1, (F.floor(F.col("n") / 5) + 1 - F.col("own")).cast("int"))
    placed = ranked.select("fp", "n", "own", F.posexplode(first).alias("place", "s"))
    place = F.col("own") + F.col("place")
    return placed.select("s.shingle", "fp", "n", "own", place.alias("place"), (place <= F.floor(F.col("n") / 9)).alias("is_index"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (src, dst) with Jaccard similarity of at least 4/5."""
    left, right = (sets.select(F.col("fp").alias(name), F.col("shingles").alias(f"of_{name}")) for name in ("src", "dst"))
    common = F.size(F.array_intersect("of_src", "of_dst"))
    return pairs.join(left, "src").join(right, "dst").where(9 * common >= 4 * (F.size("of_src") + F.size("of_dst"))).select("src", "dst")


def similar_links(texts: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(src, dst) of texts (fp, text) with distinct fp: similar pairs, enough of them to keep all that are connected connected."""
    lonely = _lonely(texts, shingle_words)
    near = materialize(texts.join(lonely, "fp", "left_anti"), "similar-texts")
    discard(lonely)
    shingles = materialize(_shingle_rows(near, shingle_words, None), "similar-shingles")
    held = _held(shingles)
    prefixes = materialize(_prefixes(shingles, held), "similar-prefixes")
    discard(shingles, held)
    sizes = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("own") / F.col("n"), "fp", "n", "own")).alias("hub")).where("size > 1")
    sizes = materialize(sizes, "similar-buckets")
    met = materialize(prefixes.join(sizes.select("shingle", "hub"), "shingle"), "similar-met")
    discard(prefixes, sizes)

    def sets_of(keys: DataFrame) -> DataFrame:
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [shingle_hashes(t.as_py(), shingle_words) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["fp", "shingles"])

        return near.join(keys, "fp", "left_semi").select("fp", "text").mapInArrow(of_batches, "fp long, shingles array<long>")

    sets = materialize(sets_of(met.select("fp").distinct()), "similar-sets")
    discard(near)
    # Where two texts first meet, from rare to common, they have at most what is left of either in common: 9 * common >= 4 * (n + n) for 4/5.
    may_be = "5 * {a}.n >= 4 * {b}.n AND 9 * ({a}.own + {b}.own) <= {a}.n + {b}.n AND 9 * least({a}.n - {a}.place, {b}.n - {b}.place) >= 4 * ({a}.n + {b}.n)"
    to_hub = met.select("fp", "n", "own", "hub").where("fp <> hub.fp AND 5 * n >= 4 * hub.n AND 5 * hub.n >= 4 * n AND 9 * (own + hub.own) <= n + hub.n")
    hub_links = materialize(_similar(to_hub.select(F.col("fp").alias("src"), F.col("hub.fp").alias("dst")).distinct(), sets), "similar-hubs")
    components = connected_components(hub_links).select(F.col("node").alias("fp"), "component")
    labelled = met.drop("hub").join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = materialize(labelled, "similar-labelled")
    discard(met)
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("shingle")
    rest = materialize(labelled.join(mixed, "shingle", "left_semi"), "similar-rest")
    discard(labelled)
    a, b = rest.where("is_index").alias("a"), rest.alias("b")
    order = F.expr("a.component <> b.component AND (a.n < b.n OR (a.n = b.n AND a.fp < b.fp)) AND " + may_be.format(a="a", b="b"))
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & order).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()
    links = materialize(hub_links.union(_similar(pairs, sets)), "similar-links")
    discard(rest, sets, hub_links)
    return links


def fingerprint_ties(texts: DataFrame, shingle_words: int = 5, max_distance: int = 2) -> DataFrame:
    """(src, dst) of texts (fp, text) with distinct fp: those that chains of SimHash fingerprints at most max_distance bits apart connect, each tied to one of its class."""
    classes = near_duplicate_classes(texts, "fp", "text", shingle_words, max_distance)
    return classes.where("id <> component_id").select(F.col("id").alias("src"), F.col("component_id").alias("dst"))


def keep_one_of_similar(docs: DataFrame, shingle_words: int = 5, max_distance: int | None = None) -> DataFrame:
    """One document of every class of similar texts, with all its columns: texts that chains of Jaccard similarities of at least 0.8 connect.

    With max_distance, SimHash fingerprints at most so many bits apart connect texts as well. Rows that share a doc_id count as one
    document and stay together if any of them names its class. Rows without a doc_id stay.
    """
    keyed = text_keys(docs)  # taken twice, which costs less than to write all texts
    prints = materialize(keyed.select("id", "fp"), "similar-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "similar-distinct")
    texts = materialize(keyed.groupBy("fp").agg(F.min("text").alias("text")), "similar-distinct-texts")
    links = similar_links(texts, shingle_words)
    if max_distance is not None:
        links = materialize(links.union(fingerprint_ties(texts, shingle_words, max_distance)), "similar-ties")
    discard(texts)
    return keep_named(docs, named_classes(prints, distinct, links))
