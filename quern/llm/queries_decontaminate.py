"""op4: benchmark items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import MIN_SHARE, SLIP, SPAN, item_members, overlaps, share_of
from quern.session import table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and items, and for items whose words another has (no document) that one's id as class_id."""
    benchmark = table(spark, sf_dir, "benchmark")
    pairs = overlaps(table(spark, sf_dir, "documents"), benchmark).withColumn("class_id", F.col("item_id"))
    copies = item_members(benchmark).where("item_id is null or item_id <> class_id")
    return pairs.unionByName(copies, allowMissingColumns=True).select("doc_id", "item_id", "class_id", "n_item", "n_covered")


_NEED = " ".join(f"WHEN {n} THEN {share_of(n)}" for n in range(1, SPAN))

ORACLE = rf"""
WITH words AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id AS id, text FROM documents UNION ALL SELECT 'b', 0, item_id, text FROM benchmark),
split AS (SELECT side, row, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM words),
members AS (SELECT id AS item_id, min(id) OVER (PARTITION BY w) AS class_id, w FROM split WHERE side = 'b' AND len(w) > 0),
items AS (SELECT class_id AS item_id, len(w) AS n, CASE len(w) {_NEED} ELSE {share_of(SPAN)} END AS need, unnest(w) AS word, unnest(range(len(w))) AS k FROM (SELECT DISTINCT class_id, w FROM members)),
places AS (SELECT row, id AS doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM split WHERE side = 'd'),
same AS (SELECT row, doc_id, item_id, n, need, k, p - k AS place FROM places JOIN items USING (word)),
dense AS (SELECT DISTINCT row, doc_id, item_id, n, place FROM (SELECT *, count(*) OVER (PARTITION BY row, item_id, place ORDER BY k RANGE BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS near FROM same) WHERE near >= need),
covered AS (SELECT d.doc_id, d.item_id, d.n, count(DISTINCT s.k) AS c FROM dense d JOIN same s ON s.row = d.row AND s.item_id = d.item_id AND s.place BETWEEN d.place - {SLIP} AND d.place + {SLIP} GROUP BY d.row, d.doc_id, d.item_id, d.n, d.place)
SELECT doc_id, item_id, item_id AS class_id, n::BIGINT AS n_item, max(c)::BIGINT AS n_covered FROM covered GROUP BY doc_id, item_id, n HAVING max(c) >= {MIN_SHARE} * n
UNION ALL SELECT NULL, item_id, class_id, NULL, NULL FROM members WHERE item_id IS NULL OR item_id <> class_id
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": ORACLE}
