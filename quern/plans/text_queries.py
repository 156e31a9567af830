"""Queries on documents and pages: chunkers, filters, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions.table_functions import register_chunkers
from quern.operators import chunking, cohesion, filters, records
from quern.session import spread, table
from quern.sources import scans, sinks
from quern.workspace import fresh_path

HEADERS = ("The.", "And.", "Of.", "In.", "La.", "De.", "Die.")
WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_size(_docs(spark, sf_dir), size=64, overlap=50)


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("pos", "sentence"))


def chunk_lumber_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lumber(_docs(spark, sf_dir), cap=64, separator="\n")


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive(_docs(spark, sf_dir), size=64, overlap=50)


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = chunking.semantic_groups(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return grouped.groupBy("label", "chunk_no").agg(F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def chunk_cohesive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document in the cheapest cut by their words."""
    return cohesion.cohesive_chunks(_docs(spark, sf_dir))


def chunk_words_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_fixed through a table function in SQL."""
    register_chunkers(spark)
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return spark.sql("SELECT * FROM chunk_words(TABLE({docs}), 'text', 64, 50)", docs=docs)


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents of a source after the other as the pages of one: cut where their words change, three pages at least."""
    pages = _docs(spark, sf_dir).select(F.concat_ws("/", "source", F.expr("doc_id div 8").cast("string")).alias("doc"), "doc_id", "text")
    merged = cohesion.cohesive_pages(pages, "doc", "doc_id", "text")
    return merged.select("doc", "pos", "start_idx", "end_idx", F.length("chunk").alias("n_chars"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(value))
    return table(spark, sf_dir, "pages").select("page_id", F.btrim(F.regexp_replace(bare, r"[ \t\n\r]+", " ")).alias("text"))


def header_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = _docs(spark, sf_dir).select("doc_id", filters.trim_to_header(F.col("text"), HEADERS).alias("trimmed"))
    return trimmed.where("trimmed is not null")


def header_trim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = _docs(spark, sf_dir).select(filters.trim_to_header(F.col("text"), HEADERS).alias("trimmed"))
    saved = F.count_if(F.col("trimmed").isNotNull())
    return trimmed.agg(saved.alias("saved"), F.count_if(F.col("trimmed").isNull()).alias("skipped"), (saved / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("ratio"))


def useful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", filters.looks_useful(F.col("text")).alias("is_useful"))


def drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_blank(_docs(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def natural_sort_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select("page_id", "url", t.natural_key(F.col("url")).alias("key"))
    return records.running_ids(keyed, ["key", "page_id"], 1, "place").select("place", "page_id", "url")


def sanitize_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.store_name(F.col("url")).alias("store"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split(url, "/"), -1).alias("file_name"), t.stem(url).alias("stem"), F.regexp_replace(url, "/[^/]*$", "").alias("parent"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.lines_clean(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), F.array_join(F.slice(lines, 1, 2), "|").alias("head"))


def prose_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' prose written as files beside where their sources stood, and read again."""
    pages = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.format_string("doc_%06d.md", "doc_id")).alias("rel_path"), F.col("text").alias("prose"))
    folder = fresh_path(spark, "prose")
    found = scans.written_pages(sinks.write_files(sinks.prose_files(pages), folder), folder)
    return found.select("rel_path", "stem", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


QUERIES = {f.__name__: f for f in (chunk_fixed, chunk_sentences, chunk_lumber_cap, chunk_recursive, chunk_semantic, chunk_cohesive, chunk_words_sql, page_merge, html_to_text, header_trim, header_trim_counts, useful_filter, drop_blank, natural_sort_pages, sanitize_store, path_parts, doc_lines, prose_layout)}

_HEADER_LIST = "[" + ", ".join(f"'{h}'" for h in HEADERS) + "]"
_TRIM_SQL = f"""SELECT doc_id, CASE WHEN spot IS NOT NULL THEN array_to_string(l[spot:], chr(10)) END AS trimmed
    FROM (SELECT doc_id, l, list_min(list_filter(range(1, len(l) + 1), lambda i: list_contains({_HEADER_LIST}, trim(l[i])))) AS spot FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
_SENTENCES_SQL = r"list_filter(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
_COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"

_FIXED_SQL = f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), k AS (SELECT *, CASE WHEN len(w) <= 64 THEN 1 ELSE ceil((len(w) - 64) / 14.0)::INT + 1 END AS k FROM w WHERE len(w) > 0)
        SELECT doc_id, i::INT AS pos, array_to_string(w[i * 14 + 1:i * 14 + 64], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(k)) AS i FROM k)"""

ORACLES = {
    "chunk_words_sql": _FIXED_SQL,
    "prose_layout": """SELECT lang || '/' || source || '/doc_' || lpad(doc_id::VARCHAR, 6, '0') || '_prose.md' AS rel_path, 'doc_' || lpad(doc_id::VARCHAR, 6, '0') || '_prose' AS stem, sha256(trim(text, ' ')) AS sha
        FROM documents WHERE regexp_matches(text, '[^\\s]')""",
    "chunk_fixed": _FIXED_SQL,
    "chunk_sentences": f"SELECT doc_id, (i - 1)::INT AS pos, trim(s[i]) AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES_SQL} AS s FROM documents))",
    "chunk_lumber_cap": rf"""WITH RECURSIVE p AS (SELECT doc_id, i, trim(l[i]) AS t, len(list_filter(string_split_regex(l[i], '\s+'), lambda x: x <> '')) AS w
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))),
        f AS (SELECT doc_id, i, t, w AS total, 0 AS pos FROM p WHERE i = 1 UNION ALL
            SELECT p.doc_id, p.i, p.t, CASE WHEN f.total + p.w <= 64 THEN f.total + p.w ELSE p.w END, CASE WHEN f.total + p.w <= 64 THEN f.pos ELSE f.pos + 1 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
        SELECT doc_id, pos::INT AS pos, (min(i) - 1)::INT AS start_idx, (max(i) - 1)::INT AS end_idx, string_agg(t, chr(10) || chr(10) ORDER BY i) AS chunk FROM f GROUP BY doc_id, pos""",
    "chunk_semantic": f"""WITH d AS (SELECT label, vec_id, 1 - {_COSINE.format(a="embedding", b="nxt")} AS d FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)),
        b AS (SELECT d.*, coalesce(d.d > t, false)::INT AS b FROM d JOIN (SELECT label, quantile_cont(d, 0.9) AS t FROM d GROUP BY label) USING (label)),
        g AS (SELECT label, vec_id, coalesce(sum(b) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_no FROM b)
        SELECT label, chunk_no, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS n FROM g GROUP BY label, chunk_no""",
    "html_to_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""",
    "header_trim": f"SELECT * FROM ({_TRIM_SQL}) WHERE trimmed IS NOT NULL",
    "header_trim_counts": f"SELECT count(trimmed) AS saved, count(*) - count(trimmed) AS skipped, count(trimmed) / greatest(count(*), 1) AS ratio FROM ({_TRIM_SQL})",
    "useful_filter": rf"""SELECT doc_id, len({WORDS_SQL}) >= 5 AND coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest({_SENTENCES_SQL}) AS s) GROUP BY trim(s))), 0) < 10
        AND length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', '', 'g')) <= 0.5 * length(text) AS is_useful FROM documents""",
    "drop_blank": r"SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE regexp_matches(text, '\S') GROUP BY lang",
    "natural_sort_pages": r"""SELECT row_number() OVER (ORDER BY key, page_id) AS place, page_id, url FROM (SELECT page_id, url,
        list_transform(regexp_extract_all(url, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE lower(p) END) AS key FROM pages)""",
    "sanitize_store": "SELECT page_id, trim(substring('cleaned_' || trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 1, 63), '_-.') AS store FROM pages",
    "path_parts": r"SELECT page_id, string_split(url, '/')[-1] AS file_name, regexp_replace(string_split(url, '/')[-1], '(.)\.[^.]*$', '\1') AS stem, regexp_replace(url, '/[^/]*$', '') AS parent FROM pages",
    "doc_lines": "SELECT doc_id, len(l)::INT AS n_lines, array_to_string(l[1:2], '|') AS head FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)",
}
