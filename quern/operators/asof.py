"""As-of join: to each row of one table the newest row of another that is not newer than it.

Both tables are merged and sorted by key, time and kind, and written in ranges of about equal size: a key that holds most rows runs through
many of them, and rows of one moment are split by a number of their own. Within a range the last row of the other table is carried along; what the
first rows of a range need comes from a table with one row per range and key, the last that the ranges before it hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.workspace import materialize

FOUND_TIME = "found_time"


def _ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str], tie: Sequence[str], exact: bool) -> DataFrame:
    """part, at, key, mine (null for rows of right), found (null for rows of left): all rows by key and time; at ascends through all parts."""
    key = F.struct(F.lit(0).alias("k"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    mine = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)])
    found = F.struct(F.col(right_time).alias(FOUND_TIME), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    ties = F.struct(F.lit(0).alias("t"), *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(tie)])
    readings = right.where(F.col(right_time).isNotNull()).select(key.alias("key"), F.col(right_time).alias("time"), F.lit(0 if exact else 2).alias("kind"), ties.alias("tie"), found.alias("found"))
    requests = left.select(key.alias("key"), F.col(left_time).alias("time"), F.lit(1).alias("kind"), mine.alias("mine"))
    order = ["key", "time", "kind", "tie", "salt"]
    merged = readings.unionByName(requests, allowMissingColumns=True).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(dealt.select(F.shiftright("at", 33).alias("part"), "at", "key", "mine", "found"), "asof-ranges")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str], tie: Sequence[str] = (), exact: bool = True, tolerance: Column | None = None) -> DataFrame:
    """left with found_time and ``fields`` of the newest row of right with equal keys whose time is not after the row's own (``exact``), or is before it.

    Of rows of right with one time the one with the largest ``tie`` counts. Null keys equal each other; rows of left without a time or without an
    earlier row get nulls, and rows of right without a time are never found. All rows of left stay, as often as they are there. ``tolerance``, an
    expression over left's columns and found_time, says whether what was found is still good. An empty right gives nulls throughout. Fields must
    not have names of left's columns.
    """
    clash = (set(fields) | {FOUND_TIME}) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    rows = _ranges(left, right, keys, left_time, right_time, fields, tie, exact)
    spans = rows.groupBy("part", "key").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("at"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    entering = spans.withColumn("entering", before).where("entering is not null").select("part", "key", "entering")
    inside = F.last("found", ignorenulls=True).over(W.partitionBy("part", "key").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    carried = rows.withColumn("inside", inside).where("mine is not null").join(entering, ["part", "key"], "left")
    chosen = carried.select("mine", F.coalesce("inside", "entering").alias("found"))
    named = chosen.select(*[F.col(f"mine.c{i}").alias(c) for i, c in enumerate(left.columns)], F.col(f"found.{FOUND_TIME}").alias(FOUND_TIME), *[F.col(f"found.f{i}").alias(f) for i, f in enumerate(fields)])
    if tolerance is None:
        return named
    good = named.withColumn("__good", tolerance)
    return good.select(*left.columns, *[F.when(F.col("__good"), F.col(f"`{f}`")).alias(f) for f in (FOUND_TIME, *fields)])
