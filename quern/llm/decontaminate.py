"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts become lower-case words without punctuation, hashed to 64 bits. A mask selects some words of a stretch of SPAN and ignores the others, which may
differ; a key is the hash of the words that a mask selects at a place. Keys of documents and benchmark items are joined, and at every place that a
hit gives the whole item is laid beside the document and compared word by word.

The masks are all ways to select as many of SPAN words as ``min_share`` of SPAN asks for, and of items shorter than SPAN their own share. They
miss nothing: where min_share of an item's words agree, that many stand within some stretch of SPAN. (Cut the item into stretches of SPAN and
a rest of r words; with fewer in each stretch, too few agree in all as soon as the item is longer than 3 r, at 0.6. Tests list the shorter ones.) So
any substitutions that leave min_share of the words in place are found, at an item's ends as well. (At 0.75 one pattern of eight words is missed.)
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.workspace import materialize

SPAN = 5
#: Words of an item that must agree.
MIN_SHARE = 0.6
#: How far beside its place a word may stand, for words put in or left out.
SLIP = 2
BROADCAST_KEYS = 200_000  # about 10 MB


def share_of(n: int, min_share: float = MIN_SHARE) -> int:
    """The fewest words that are min_share of n."""
    return math.ceil(min_share * n - 1e-9)


def masks_for(n: int, min_share: float = MIN_SHARE) -> list[tuple[int, ...]]:
    """The masks of items of n words, 1 or more: offsets of the words that count, the first of them 0."""
    span = min(n, SPAN)
    return [(0, *rest) for rest in combinations(range(1, span), share_of(span, min_share) - 1)]


def _hashed(text: Column) -> Column:
    """Hashes of a text's words, a null text as empty."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _keyed(rows: DataFrame, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """(keep, at, mask, key): one row for each place of the words h and each mask that fits there."""
    zipped = F.expr("arrays_zip(" + ", ".join(f"slice(h, {k + 1}, size(h))" for k in range(SPAN)) + ")")
    places = rows.select(*keep, F.posexplode(zipped).alias("at", "w")).select(*keep, "at", *(F.col(f"w.`{k}`").alias(f"w{k}") for k in range(SPAN)))
    number = lambda mask: F.lit(sum(1 << k for k in mask))
    keys = [F.struct(number(mask).alias("mask"), F.when(F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(number(mask), *(f"w{k}" for k in mask))).alias("key")) for mask in masks]
    return places.select(*keep, "at", F.inline(F.array(*keys))).where("key is not null")


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_item, h): items with words, one of those with equal words; the smallest id stands for all."""
    tokens = benchmark.select(F.col(id_col).cast("long").alias("item_id"), _hashed(F.col(text_col)).alias("h")).where(F.size("h") > 0)
    return tokens.groupBy("h").agg(F.min("item_id").alias("item_id")).select("item_id", F.size("h").alias("n_item"), "h")


def item_members(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, class_id): every item with words, and the id that stands for its words in overlaps()."""
    tokens = benchmark.select(F.col(id_col).cast("long").alias("member"), _hashed(F.col(text_col)).alias("h")).where(F.size("h") > 0)
    classes = materialize(item_classes(benchmark, id_col, text_col).select("h", "item_id"), "bench-classes")
    return tokens.join(classes, "h").select(F.col("member").alias("item_id"), F.col("item_id").alias("class_id"))


def _item_keys(items: DataFrame, min_share: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(item, place, key) of the items, each under the masks of its length, and all masks that occur."""
    spans = sorted(r["span"] for r in items.select(F.least("n_item", F.lit(SPAN)).alias("span")).distinct().collect())  # SPAN numbers at most
    of_span = {span: masks_for(span, min_share) for span in spans}
    masks = sorted({mask for family in of_span.values() for mask in family})
    own = F.lit(False)
    for span, family in of_span.items():
        own = own | ((F.least("n_item", F.lit(SPAN)) == span) & F.col("mask").isin([sum(1 << k for k in mask) for mask in family]))
    keyed = _keyed(items, masks, "item_id", "n_item").where(own) if masks else items.selectExpr("item_id", "0 as at", "0L as key").where("false")
    return materialize(keyed.select(F.col("item_id").alias("item"), F.col("at").alias("place"), "key"), "bench-keys"), masks


def _covered(min_share: float) -> Column:
    """Of ``wanted``, the items of a document with the places to look at: (item_id, n_item, n_covered) of those it holds, h being the document's words."""
    beside = " or ".join(f"get(h, d + k + {j}) = get(x.b, k)" for j in range(-SLIP, SLIP + 1))
    most = f"array_max(transform(x.places, d -> size(filter(sequence(0, x.n_item - 1), k -> {beside}))))"
    counted = f"transform(wanted, x -> named_struct('item_id', x.item, 'n_item', cast(x.n_item as bigint), 'n_covered', cast({most} as bigint)))"
    return F.expr(f"filter({counted}, x -> x.n_covered >= {min_share} * x.n_item)")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, n_item, n_covered): each document with each benchmark item it holds; of items with equal words the one that stands for them.

    A place is where the words that a mask selects agree. There n_covered counts the item's words that stand in the document where the place puts them or
    up to SLIP words beside, and the place with most counts. Rows that share an id count as one document, rows without one as one more.
    Null and empty texts hold nothing; repeated rows add nothing. An empty table on either side gives no rows.

    Documents are read twice: for places, of which only numbers are shuffled, and, those that have any, for their words. A document is known by its id and
    the hash of its text, so rows without an id do not meet in one task; two texts with one hash would only be looked at in places more.
    """
    items = materialize(item_classes(benchmark), "bench-items")
    keyed, masks = _item_keys(items, min_share)
    few = keyed.count() <= BROADCAST_KEYS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumn("hash", F.xxhash64("t"))
    places = _keyed(texts.select("doc_id", "hash", _hashed(F.col("t")).alias("h")), masks, "doc_id", "hash") if masks else texts.selectExpr("doc_id", "hash", "0 as at", "0L as key").where("false")
    hits = places.join(F.broadcast(keyed) if few else keyed, "key").select("doc_id", "hash", "item", (F.col("at") - F.col("place")).alias("place"))
    found = hits.groupBy("doc_id", "hash", "item").agg(F.collect_set("place").alias("places"))
    found = found.join(items.select(F.col("item_id").alias("item"), "n_item", F.col("h").alias("b")), "item")
    wanted = found.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("item", "n_item", "b", "places")).alias("wanted"))
    wanted = materialize(wanted.withColumnsRenamed({"doc_id": "__doc", "hash": "__hash"}), "bench-places")
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("hash") == F.col("__hash")))
    held = met.select("doc_id", _hashed(F.col("t")).alias("h"), "wanted").select("doc_id", F.inline(_covered(min_share)))
    return held.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_covered").alias("n_covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs whose doc_id holds no benchmark item, with all their columns."""
    held = overlaps(docs, benchmark, min_share=min_share).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("__held")), "left_anti")
