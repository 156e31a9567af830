"""op11: verdicts on the URLs of pages, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quern.llm.url_filter import GLOB_RULES, HOST_RULES, LOWER, UPPER, judge_urls
from quern.session import table


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _regex(glob: str) -> str:
    """A glob as a regular expression, for SQL only."""
    parts = re.findall(r"\*\*|\*|\?|\[!?.[^\]]*\]|.", glob)
    return "".join({"**": "(?s:.)*", "*": "[^/?]*", "?": "[^/?]"}.get(p) or (p.replace("[!", "[^") if len(p) > 1 else re.escape(p)) for p in parts)


_HOSTS = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in sorted(HOST_RULES, key=lambda r: -len(r.host + r.path))]
_GLOBS = [(f"regexp_full_match(url, '{_regex(r.glob)}')", r) for r in sorted(GLOB_RULES, key=lambda r: (-r.weight, r.action != "block", r.glob))]
_RULE = "CASE " + " ".join(f"WHEN {test} THEN '{r.host}{r.path}'" for test, r in _HOSTS) + " END"
_PATTERN = "CASE " + " ".join(f"WHEN {test} THEN '{r.glob}'" for test, r in _GLOBS) + " END"
_ACTIONS = ", ".join(f"('{name}', '{action}')" for name, action in {**{r.glob: r.action for r in GLOB_RULES}, **{r.host + r.path: r.action for r in HOST_RULES}}.items())

ORACLE = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
behind AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, substr(rest, length(raw) + 1) AS more FROM named),
parts AS (SELECT page_id, host, regexp_extract(more, '^[^?#]*') AS path, regexp_extract(more, '^[^#]*') AS tail FROM behind),
ruled AS (SELECT page_id, host, path, host || tail AS url, {_RULE} AS rule FROM parts),
judged AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN {_PATTERN} END AS pattern FROM ruled),
actions AS (SELECT * FROM (VALUES {_ACTIONS}) AS v(name, action))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict, pattern FROM judged LEFT JOIN actions ON name = coalesce(rule, pattern)
"""

QUERIES = {"op11_urls": op11_urls}
ORACLES = {"op11_urls": ORACLE}
