"""op13: how sources of a language differ in their words, and the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.divergence import MIN_DOCS, PRIOR, SCALE, TERM_RANKS, audit_sources
from quern.llm.url_filter import LOWER, UPPER
from quern.session import table


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def _share(count: str, total: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({count} + {PRIOR})) // ({total} + {PRIOR} * kept))::BIGINT"


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
words AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
sizes AS (SELECT lang, count(*)::HUGEINT AS kept FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, v.term, kept, coalesce(n, 0) AS n FROM groups g JOIN vocabulary v USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM dense),
shares AS (SELECT lang, source, term, n, {_share("n", "total")} AS p, {_share("lang_n", "lang_total")} AS q FROM summed),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {"op13_divergence": ORACLE}
