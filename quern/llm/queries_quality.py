"""op2: quality rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import quality
from quern.session import table

_BUCKET = "((({v}) >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"

COUNTS_SQL = r"""
counted AS (
    WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    split AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM rows),
    windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM (
        SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS tri FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3))),
    covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid)
    SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[\p{P}\p{S}]'))::BIGINT AS n_marks, length(t)::BIGINT AS n_text
    FROM split LEFT JOIN covered USING (rid)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, (1000 * n_marks) // greatest(n_text, 1) AS marks,
        (100 * word_chars) // greatest(n_words, 1) AS word_length FROM counted),
listed AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket
    FROM (SELECT * FROM measured WHERE NOT base_failed) UNPIVOT (value FOR measure IN (marks, word_length)) WHERE value > 0),
spreads AS (SELECT * FROM (VALUES ('marks', 4), ('word_length', 6)) AS v(measure, spread)),
levels AS (SELECT 'group' AS level, lang, source, measure, bucket FROM listed UNION ALL SELECT 'lang', lang, '', measure, bucket FROM listed
    UNION ALL SELECT 'all', '', '', measure, bucket FROM listed),
sketch AS (SELECT level, lang, source, measure, bucket, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sketch),
fence AS (SELECT level, lang, source, measure, max(total)::BIGINT AS n, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END)
        + max(spread) * (min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) - min(CASE WHEN 4 * upto >= total THEN bucket END)) AS fence
    FROM ranked JOIN spreads USING (measure) GROUP BY level, lang, source, measure),
langs AS (SELECT d.lang, a.measure, coalesce((l.n * l.fence + 100 * a.fence) // (l.n + 100), a.fence) AS fence FROM (SELECT DISTINCT lang FROM measured) d
    JOIN fence a ON a.level = 'all' LEFT JOIN fence l ON l.level = 'lang' AND l.lang = d.lang AND l.measure = a.measure),
chosen AS (SELECT d.lang, d.source, l.measure, coalesce((g.n * g.fence + 100 * l.fence) // (g.n + 100), l.fence) AS fence FROM (SELECT DISTINCT lang, source FROM measured) d
    JOIN langs l USING (lang) LEFT JOIN fence g ON g.level = 'group' AND g.lang = d.lang AND g.source = d.source AND g.measure = l.measure),
bounds AS (SELECT lang, source, max(CASE WHEN measure = 'marks' THEN fence END) AS f1, max(CASE WHEN measure = 'word_length' THEN fence END) AS f2 FROM chosen GROUP BY lang, source),
judged AS (SELECT m.*, coalesce(""" + _BUCKET.format(v="marks") + r""" > f1, false) OR coalesce(""" + _BUCKET.format(v="word_length") + r""" > f2, false) AS beyond
    FROM measured m LEFT JOIN bounds USING (lang, source))
"""



def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judged(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op2_quality": op2_quality}
ORACLES = {"op2_quality": f"WITH {COUNTS_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM judged"}
