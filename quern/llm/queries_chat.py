"""op6: dialogues from every speaker's perspective, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.chat import BEGIN, END, PART_TURNS, SYSTEM, rotate_perspectives
from quern.session import table


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return rotated.withColumn("mask", F.expr("array_join(transform(mask, r -> concat(r.start, ':', r.end)), ',')"))


ORACLE = f"""
WITH clean AS (SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS body,
        CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE regexp_replace(replace(trim(role), '<|', '< |'), '[ \\t-\\r]+', ' ', 'g') END AS who FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, body) - 1 AS pos FROM clean),
speakers AS (SELECT DISTINCT conv_id, who AS speaker FROM clean WHERE who <> '{SYSTEM}'),
parts AS (SELECT c.conv_id, s.speaker, c.pos, c.pos // {PART_TURNS} AS part, c.body, who = speaker AS own, body || '{END}' AS tail,
        CASE WHEN who = speaker THEN '{BEGIN}assistant' WHEN who = '{SYSTEM}' THEN '{BEGIN}system' ELSE '{BEGIN}user name=' || who END || chr(10) AS head
    FROM numbered c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(tail) - 1 AS start FROM parts)
SELECT conv_id, speaker, part, string_agg(head || tail || chr(10), '' ORDER BY pos) AS rendered,
    coalesce(string_agg(start || ':' || (start + length(tail)), ',' ORDER BY pos) FILTER (own), '') AS mask, count(*) AS n_turns, count(*) FILTER (own) AS n_own
FROM placed GROUP BY conv_id, speaker, part
"""

QUERIES = {"op6_chat": op6_chat}
ORACLES = {"op6_chat": ORACLE}
