"""Paired tests and box statistics of metric scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.models import normal_tail


def summarize(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, average, std): mean and sample deviation of each metric's column, nulls and NaN left out; one row has no deviation."""
    long = to_long(scores, [], metrics)
    return long.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("metric").agg(F.avg("score").alias("average"), F.stddev_samp("score").alias("std"))


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, score)."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", "score")


def paired_wide(df: DataFrame, qid: str, setting: str, settings: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per question with a column {metric}_{setting} each; the first value where a setting has several."""
    picked = [F.min(F.when(F.col(setting) == s, F.col(m))).alias(f"{m}_{s}") for m in metrics for s in settings]
    return df.where(F.col(setting).isin(*settings)).groupBy(qid).agg(*picked)


def wilcoxon(wide: DataFrame, metrics: Sequence[str], a: str, b: str) -> DataFrame:
    """(metric, n, v, z): paired signed-rank statistics of {metric}_{a} against {metric}_{b}.

    n counts complete pairs; zero differences are then left out, absolute differences ranked with ties averaged; z has the
    correction for continuity and for ties. z is null where no difference is left.
    """
    listed = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_{a}").cast("double") - F.col(f"{m}_{b}").cast("double")).alias("d")) for m in metrics))
    long = wide.select(F.explode(listed).alias("x")).select("x.metric", "x.d").where("d is not null and not isnan(d)")
    # Equal absolute differences are summed up first, so that ranking sees one row per value.
    values = long.groupBy("metric", F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    kept = values.where("size > 0").withColumn("below", F.coalesce(F.sum("t").over(W.partitionBy("metric").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("below") + (F.col("t") + 1) / 2
    sums = kept.groupBy("metric").agg(F.sum(rank * F.col("up")).alias("v"), F.sum("t").alias("m"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    counts = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    m = F.col("m").cast("double")
    centred = F.col("v") - m * (m + 1) / 4
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (centred - F.signum(centred) * 0.5) / spread)
    return counts.join(sums, "metric", "left").select("metric", "n", F.coalesce("v", F.lit(0.0)).alias("v"), z.alias("z"))


def with_p_value(tests: DataFrame) -> DataFrame:
    """p: two-sided, from the normal distribution."""
    return tests.withColumn("p", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests (one small row per metric) with p_holm, sig_label and significant_holm."""
    rows = tests.withColumn("__i", F.row_number().over(W.orderBy(p, "metric"))).withColumn("__m", F.count(F.lit(1)).over(W.partitionBy()))
    stepped = F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(W.orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    adjusted = rows.withColumn("p_holm", F.least(F.lit(1.0), stepped)).drop("__i", "__m")
    return adjusted.withColumn("sig_label", stars(F.col("p_holm"))).withColumn("significant_holm", F.col("p_holm") < 0.05)


def box_stats(long: DataFrame, keys: Sequence[str] = ("metric", "method"), score: str = "score", digits: int = 4) -> DataFrame:
    """(keys, n, whisker_low, q1, median, q3, whisker_high, n_outliers, outliers): Tukey's hinges, whiskers at the outermost scores within
    1.5 hinge spreads, and the rest as text joined by ";". Equal scores are counted before they are ordered."""
    keys = list(keys)
    counted = long.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, F.col(score).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(*keys).orderBy("x")
    placed = counted.withColumn("hi", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(*keys)))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("hi") >= place, F.col("x")))

    depth = F.floor((F.col("n") + 3) / 2) / 2
    ends = {"q1": depth, "median": (F.col("n") + 1) / 2, "q3": F.col("n") + 1 - depth}
    found = placed.groupBy(*keys).agg(F.max("n").alias("n"), *(((at(F.floor(d)) + at(F.ceil(d))) / 2).alias(name) for name, d in ends.items()))
    fenced = counted.join(found, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    outliers = F.array_sort(F.flatten(F.collect_list(F.when(~inside, F.array_repeat(F.round("x", digits), F.col("c").cast("int"))))))
    return fenced.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("n_outliers"), F.array_join(F.transform(outliers, lambda x: x.cast("string")), ";").alias("outliers"),
    )


def box_table(boxes: DataFrame, tests: DataFrame, digits: int = 4) -> DataFrame:
    """box_stats() with the Holm columns of the test of each metric (one small row each), summary values rounded; metrics without a test keep their boxes."""
    rounded = {c: F.round(c, digits) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")}
    return boxes.join(tests.select("metric", "p_holm", "sig_label", "significant_holm"), "metric", "left").withColumns(rounded)


def separate_rows(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """One row per number in a joined column; what is no number goes."""
    return df.withColumn(column, F.explode(F.split(column, sep))).withColumn(column, F.col(column).try_cast("double")).where(F.col(column).isNotNull())


def label_height(long: DataFrame, keys: Sequence[str] = ("metric",), score: str = "score") -> DataFrame:
    """(keys, low, high, range, y): where a significance label stands: a tenth of the range above the highest score, 0.05 if there is no range."""
    found = long.groupBy(*keys).agg(F.min(score).alias("low"), F.max(score).alias("high")).withColumn("range", F.col("high") - F.col("low"))
    return found.withColumn("y", F.when(F.col("range") > 0, F.col("high") + 0.1 * F.col("range")).otherwise(F.col("high") + 0.05))


def recode(x: Column, names: dict[str, str]) -> Column:
    """Values renamed; others pass."""
    out = None
    for old, new in names.items():
        out = F.when(x == old, new) if out is None else out.when(x == old, new)
    return x if out is None else out.otherwise(x)
