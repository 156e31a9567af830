"""Queries on series and scores: readings, rate limits, requests, paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import online, statistics
from quern.session import table

METRICS = ("qty", "price", "disc", "tax")


def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.latest_row(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


def series_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = online.series_size(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("props"))
    return sized.select("user_id", "n_rows", "n_chars", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests in six hours: the events are too sparse for a minute."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return online.rate_limit(events, "user_id", "ts", "event_id", 3, 6 * 3600).select("user_id", "event_id", "accepted")


def request_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.when(F.col("conv_id") % n > 0, "x")
    checked = online.check_request(F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")), part(2), part(3), part(5))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", checked.alias("c")).select("conv_id", "turn", "c.status", "c.mode", "c.message")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each part under the settings A and R, in whole hundredths so that sums are exact."""
    cents = lambda c: F.round(F.avg(F.round(F.col(c) * 100).cast("long")) + F.lit(1e-9), 4)
    return table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_partkey", "l_returnflag").agg(cents("l_quantity").alias("qty"), cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"))


def paired_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.paired_wide(_settings(spark, sf_dir), "l_partkey", "l_returnflag", ["A", "R"], METRICS)


def wilcoxon_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.wilcoxon(paired_wide(spark, sf_dir), METRICS, "A", "R").select("metric", "n", "v", F.round("z", 6).alias("z"))


def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = statistics.holm(statistics.with_p_value(statistics.wilcoxon(paired_wide(spark, sf_dir), METRICS, "A", "R")))
    return tests.select("metric", "n", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "sig_label", "significant_holm")


def box_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of each metric and setting with the Holm labels of the paired tests between settings."""
    tests = statistics.holm(statistics.with_p_value(statistics.wilcoxon(paired_wide(spark, sf_dir), METRICS, "A", "R")))
    table = statistics.box_table(statistics.box_stats(_long(spark, sf_dir)), tests)
    return table.select("metric", "method", "n", "whisker_low", "q1", "median", "q3", "whisker_high", F.col("n_outliers").cast("long").alias("n_outliers"), F.round("p_holm", 6).alias("p_holm"), "sig_label", "significant_holm")


def holm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "nation").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") * F.col("n_nationkey") / F.lit(4000.0) + 0.0003).alias("p"))
    return statistics.holm(tests).select("metric", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "sig_label", "significant_holm")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.to_long(_settings(spark, sf_dir), ["l_partkey", "l_returnflag"], METRICS).withColumnRenamed("l_returnflag", "method")


def pivot_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.box_stats(_long(spark, sf_dir))
    return found.select("metric", "method", "n", *(F.round(c, 6).alias(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")), F.col("n_outliers").cast("long").alias("n_outliers"))


def separate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.box_stats(_long(spark, sf_dir)).where("n_outliers > 0 and outliers <> ''")
    return statistics.separate_rows(found, "outliers").select("metric", "method", F.round("outliers", 4).alias("outlier"))


def label_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.label_height(_long(spark, sf_dir))
    return found.select("metric", *(F.round(c, 4).alias(c) for c in ("low", "high", "range", "y")))


def recode_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").select(statistics.recode(F.col("l_returnflag"), {"A": "with context", "R": "without"}).alias("setting"))
    return named.groupBy("setting").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (latest_row, series_size, rate_limit, request_route, paired_wide, wilcoxon_stat, wilcoxon_p, box_significance, holm_labels, pivot_longer, box_stats, separate_rows, label_height, recode_settings)}

_CENTS = "round(avg(round({c} * 100)::BIGINT) + 1e-9, 4)"
_SETTINGS = "st AS (SELECT l_partkey, l_returnflag, " + ", ".join(f"{_CENTS.format(c=c)} AS {m}" for c, m in (("l_quantity", "qty"), ("l_extendedprice", "price"), ("l_discount", "disc"), ("l_tax", "tax"))) + " FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)"
_WIDE = f"{_SETTINGS}, wide AS (SELECT l_partkey, " + ", ".join(f"min(CASE WHEN l_returnflag = '{s}' THEN {m} END) AS {m}_{s}" for m in METRICS for s in "AR") + " FROM st GROUP BY l_partkey)"
_LONG = f"{_SETTINGS}, long AS (SELECT l_partkey, l_returnflag AS method, metric, score FROM st UNPIVOT (score FOR metric IN (qty, price, disc, tax)))"
_BOX = f"""{_LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY metric, method ORDER BY score) AS i, count(*) OVER (PARTITION BY metric, method) AS n FROM long),
    d AS (SELECT *, floor((n + 3) / 2) / 2 AS d FROM o),
    h AS (SELECT metric, method, n, (max(score) FILTER (i = floor(d)) + max(score) FILTER (i = ceil(d))) / 2 AS q1, (max(score) FILTER (i = floor((n + 1) / 2)) + max(score) FILTER (i = ceil((n + 1) / 2))) / 2 AS median,
        (max(score) FILTER (i = floor(n + 1 - d)) + max(score) FILTER (i = ceil(n + 1 - d))) / 2 AS q3 FROM d GROUP BY metric, method, n),
    f AS (SELECT long.*, n, q1, median, q3, score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM long JOIN h USING (metric, method))"""

_WILCOXON = f"""{_WIDE}, x AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}_A - {m}_R AS d FROM wide WHERE {m}_A IS NOT NULL AND {m}_R IS NOT NULL" for m in METRICS) + """),
    k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2 AS r FROM x WHERE d <> 0),
    s AS (SELECT metric, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS v, count(*)::DOUBLE AS m FROM k GROUP BY metric), t AS (SELECT metric, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT metric, abs(d), count(*) AS c FROM k GROUP BY ALL) GROUP BY metric),
    w AS (SELECT metric, n, v::DOUBLE AS v, (v - m * (m + 1) / 4 - sign(v - m * (m + 1) / 4) * 0.5) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM s JOIN t USING (metric) JOIN (SELECT metric, count(*) AS n FROM x GROUP BY metric) USING (metric))"""
# The normal distribution's tail by Simpson's rule over 2,000 steps from 0 to |z|.
_HOLM = """p AS (SELECT metric, n, greatest(0.0, 2 * (0.5 - abs(z) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * z / 2000, 2) / 2))))) AS p FROM w),
    ordered AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS i, count(*) OVER () AS m FROM p), stepped AS (SELECT metric, n, p, least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)) AS h FROM ordered),
    labelled AS (SELECT *, CASE WHEN h < 0.001 THEN '***' WHEN h < 0.01 THEN '**' WHEN h < 0.05 THEN '*' ELSE 'n.s.' END AS sig_label, h < 0.05 AS significant_holm FROM stepped)"""

ORACLES = {
    "latest_row": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "series_size": "SELECT user_id, count(*) AS n_rows, sum(length(props))::BIGINT AS n_chars, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT user_id, event_id, i, true AS accepted, [s] AS kept FROM e WHERE i = 1 UNION ALL
            SELECT user_id, event_id, i, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, s) ELSE k END FROM (SELECT e.*, list_filter(r.kept, lambda t: t > e.s - 21600) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
        SELECT user_id, event_id, accepted FROM r""",
    "request_route": """SELECT conv_id, turn, CASE WHEN fault IS NULL THEN 'S' ELSE 'E' END AS status, CASE WHEN fault IS NULL THEN CASE WHEN conv_id % 2 > 0 AND conv_id % 3 > 0 AND conv_id % 5 > 0 THEN 'readings' ELSE 'documents' END END AS mode, coalesce(fault, 'ok') AS message
        FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 OR trim(text) = '' THEN 'empty question' WHEN length(text) > 200 THEN 'question too long' END AS fault FROM conversations)""",
    "paired_wide": f"WITH {_WIDE} SELECT * FROM wide",
    "wilcoxon_stat": f"WITH {_WILCOXON} SELECT metric, n, v, round(z, 6) AS z FROM w",
    "wilcoxon_p": f"WITH {_WILCOXON}, {_HOLM} SELECT metric, n, round(p, 6) AS p, round(h, 6)::DOUBLE AS p_holm, sig_label, significant_holm FROM labelled",
    "box_significance": f"""WITH {_BOX}, {_WILCOXON.removeprefix(_SETTINGS + ", ")}, {_HOLM}, b AS (SELECT metric, method, n, min(score) FILTER (inside) AS lo, q1, median, q3, max(score) FILTER (inside) AS hi, count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY metric, method, n, q1, median, q3)
        SELECT metric, method, b.n, round(lo, 4) AS whisker_low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(hi, 4) AS whisker_high, n_outliers, round(h, 6)::DOUBLE AS p_holm, sig_label, significant_holm FROM b LEFT JOIN labelled USING (metric)""",
    "holm_labels": """WITH t AS (SELECT n_name AS metric, n_nationkey * n_nationkey / 4000.0::DOUBLE + 0.0003::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS i, count(*) OVER () AS m FROM t),
        h AS (SELECT metric, p, least(1.0, max((m - i + 1) * p) OVER (ORDER BY i)) AS h FROM r)
        SELECT metric, round(p, 6) AS p, round(h, 6)::DOUBLE AS p_holm, CASE WHEN h < 0.001 THEN '***' WHEN h < 0.01 THEN '**' WHEN h < 0.05 THEN '*' ELSE 'n.s.' END AS sig_label, h < 0.05 AS significant_holm FROM h""",
    "pivot_longer": f"WITH {_LONG} SELECT l_partkey, method, metric, score FROM long",
    "box_stats": f"""WITH {_BOX} SELECT metric, method, n, round(min(score) FILTER (inside), 6) AS whisker_low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max(score) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY metric, method, n, q1, median, q3""",
    "separate_rows": f"WITH {_BOX} SELECT metric, method, round(score, 4) AS outlier FROM f WHERE NOT inside",
    "label_height": f"WITH {_LONG} SELECT metric, round(min(score), 4) AS low, round(max(score), 4) AS high, round(max(score) - min(score), 4) AS range, round(CASE WHEN max(score) > min(score) THEN max(score) + 0.1 * (max(score) - min(score)) ELSE max(score) + 0.05 END, 4) AS y FROM long GROUP BY metric",
    "recode_settings": "SELECT CASE l_returnflag WHEN 'A' THEN 'with context' WHEN 'R' THEN 'without' ELSE l_returnflag END AS setting, count(*) AS n FROM lineitem GROUP BY 1",
}
