"""Queries on question and answer records: shaping, filters, gates, judges, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import models
from quern.functions import judging, matching, metrics
from quern.functions.vectors import argmax, softmax
from quern.operators import filters, records, routing, statistics
from quern.session import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    return asked.join(given, ["conv_id", "turn"])


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    spaced = F.concat(F.lit(" "), F.regexp_replace("text", " ", "  "), F.lit("\n"))
    return turns.select("conv_id", "turn", metrics.exact_match(F.col("text"), F.when(F.col("turn") % 2 == 0, spaced).otherwise(F.col("role"))).alias("em"))


def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge1(F.col("reference"), F.col("generated")), 6).alias("rouge1"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.rouge_l(F.col("reference"), F.col("generated")), 6).alias("rougeL"))


def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-matching F1 of pairs, tokens weighted by how few references have them."""
    pairs = _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("at"), "reference", "generated")
    weights, unseen = matching.inverse_frequencies(pairs, "reference")
    scored = matching.token_match(pairs, "at", "reference", "generated", weights=weights, unseen=unseen)
    return scored.select("at.conv_id", "at.turn", F.round("f1", 6).alias("f1"))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _pairs(spark, sf_dir).select(metrics.exact_match(F.col("reference"), F.col("generated")).alias("em"), metrics.rouge1(F.col("reference"), F.col("generated")).alias("rouge1"))
    return statistics.summarize(scored, ["em", "rouge1"]).select("metric", F.round("average", 6).alias("average"), F.round("std", 6).alias("std"))


def metric_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text metrics of a result in one pass, then their summary."""
    a, b = F.col("reference"), F.col("generated")
    pairs = _pairs(spark, sf_dir).withColumn("va", models.hashed_embedding(a)).withColumn("vb", models.hashed_embedding(b))
    scored = pairs.select(metrics.exact_match(a, b).alias("em"), metrics.rouge1(a, b).alias("rouge1"), metrics.rouge_l(F.col("reference"), F.col("generated")).alias("rougeL"), metrics.embedding_similarity(a, b, F.col("va"), F.col("vb")).alias("sbert"))
    return statistics.summarize(scored, ["em", "rouge1", "rougeL", "sbert"])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as scored question records: scores of four decimals and some beyond, made from the id."""
    share = lambda m: ((F.col("doc_id") * m) % 20011) / F.lit(20011.0)
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("chunk_name"), F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("question"), F.col("quality").cast("string").alias("answer"), share(7919).alias("score_entailment"), share(104729).alias("score_neutral"), share(1299709).alias("score_contradiction"))


def nli_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.split_by(_scored(spark, sf_dir), filters.nli_keep("CD", 0.6))[0].select("doc_id", F.round("score_entailment", 6).alias("score"))


def nli_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.split_by(_scored(spark, sf_dir), filters.nli_keep("CD", 0.6))[1].select("doc_id", F.round("score_entailment", 6).alias("score"))


def nli_final_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    first = filters.split_by(rows, filters.nli_keep("CD", 0.5))[0]
    second = filters.split_by(rows, filters.nli_keep("QA", 0.5))[0].select("chunk_name", "question", "answer")
    return filters.null_safe_semi(first, second, ["chunk_name", "question", "answer"]).select("doc_id", "chunk_name", "question", "answer")


def nli_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    probabilities = table(spark, sf_dir, "embeddings").select("vec_id", softmax(logits).alias("p"))
    return probabilities.select("vec_id", filters.nli_class(F.col("p")).alias("label"), F.round(F.get("p", argmax(F.col("p"))), 6).alias("top"))


def nli_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count_if(filters.nli_keep("CD", 0.6))
    return _scored(spark, sf_dir).agg(kept.alias("selected"), F.count(F.lit(1)).alias("total"), F.round(kept / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("ratio"))


def qa_merge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("size"))
    return records.running_ids(turns, ["conv_id", "turn"], 0, "id")


def qa_group_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return records.number_groups(turns, "conv_id", ["turn"], "conv%s_qa%03d.json")


def pair_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.pair_up(table(spark, sf_dir, "documents"), 42, "doc_id", "text", 200).select("pair", "key_a", "key_b")


def mcq_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.split("text", " "), 1, 5).alias("w"))
    options = F.transform("w", lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
    return turns.select("conv_id", "turn", records.options_block(options).alias("block"), records.valid_choice(options, (F.col("turn") + 1).cast("string")).alias("valid"))


def qa_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from all documents' texts by the stand-in model, with declaratives."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.format_string("d%08d", "doc_id").alias("chunk_name"), F.array("source").alias("source_files"), F.col("text").alias("raw_chunk"), F.lit(None).cast("string").alias("md_summary"))
    made = records.questions_from_chunks(chunks, models.question_model)
    return records.with_declarative(made, models.echo_model).select("id", "chunk_name", "question", F.length("answer").alias("n_answer"), F.length("declarative").alias("n_declarative"))


def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores read from event properties: well formed, bare numbers, and broken ones."""
    e = table(spark, sf_dir, "events")
    shares = F.format_string("%.2f", (F.col("event_id") % 150) / F.lit(100.0))
    forms = ["score: 0.25 I think", '{"score": ', '{"label": 1}', "score is 10", "score = 0.7", '{"label": 5, "score": 0.9}', '{"score": "x"} or "score": 0.6']
    text = F.when(F.col("event_id") % 8 == 0, F.concat(F.lit('so {"score": '), shares, F.lit("} then")))
    for i, form in enumerate(forms, 1):
        text = text.when(F.col("event_id") % 8 == i, form)
    loose, strict = judging.judge(text), judging.judge(text, loose=False)
    return e.select("event_id", loose["label"].alias("label"), F.round(loose["score"], 6).alias("score"), strict["label"].alias("strict_label"), F.round(strict["score"], 6).alias("strict_score"))


def useful_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, '{"is_useful": true}').when(k == 1, '```json\n{"is_useful": false}\n```').when(k == 2, "{}").otherwise("not json")
    return table(spark, sf_dir, "events").select("event_id", judging.flag(text).alias("is_useful"))


def gate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    route = routing.gate(F.col("score_entailment"), F.col("score_neutral"), F.col("score_contradiction"), F.col("doc_id") % 13 > 0, 0.8, 0.3, 0.5)
    simple = routing.gate(None, F.col("score_neutral"), F.col("score_contradiction"), F.lit(True), relevance_at=0.3, faithfulness_at=0.5)
    return rows.select("doc_id", route.alias("route"), simple.alias("simple_route"), routing.rerank_gate(F.col("score_neutral")).alias("rerank_route"))


def token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("CAST(slice(embedding, 1, vec_id % 33) AS array<double>)").alias("a"), F.expr("CAST(slice(embedding, 33, vec_id % 3) AS array<double>)").alias("b"))
    z = routing.token_z(F.col("a"), F.col("b"))
    return halves.select("vec_id", *(F.round(z[k], 6).alias(k) for k in ("tok_mu_qc", "tok_mu_q", "tok_sigma_q")), routing.token_gate(F.col("a"), F.col("b")).alias("route"))


def iterative_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked again, shortened, while their answer has more than twenty words."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    long = F.size(F.split("generated", " ")) > 20
    critique = F.struct(long.alias("iter_needed"), F.array_join(F.slice(F.split("asked", " "), 1, 12), " ").alias("new_query"))
    return routing.iterate(questions, lambda d: d.withColumn("generated", F.reverse("asked")), lambda d: d.withColumn("critique", critique)).select("qid", "rounds", "asked", "generated")


QUERIES = {f.__name__: f for f in (exact_match, rouge1, rouge_l, token_match, metric_summary, metric_driver, nli_select, nli_reject, nli_final_intersect, nli_three_way, nli_ratio, qa_merge_ids, qa_group_number, pair_hash, mcq_format, qa_generate, json_defaults, useful_flags, gate_route, token_gate, iterative_answers)}

_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS r, b.text AS g FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
_ROUGE = rf"""{_PAIRS}, numbered AS (SELECT *, row_number() OVER () AS id FROM pairs),
    toks AS (SELECT id, 'r' AS side, unnest(list_filter(string_split_regex(r, '\s+'), lambda x: x <> '')) AS t FROM numbered UNION ALL SELECT id, 'g', unnest(list_filter(string_split_regex(g, '\s+'), lambda x: x <> '')) FROM numbered),
    counts AS (SELECT id, t, count(*) FILTER (side = 'r') AS cr, count(*) FILTER (side = 'g') AS cg FROM toks GROUP BY id, t),
    f AS (SELECT id, sum(least(cr, cg)) AS o, sum(cr) AS nr, sum(cg) AS ng FROM counts GROUP BY id),
    scored AS (SELECT conv_id, turn, r, g, CASE WHEN coalesce(nr, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1.0 WHEN coalesce(nr, 0) = 0 OR coalesce(ng, 0) = 0 OR o = 0 THEN 0.0
        ELSE 2 * (o / ng) * (o / nr) / (o / ng + o / nr) END::DOUBLE AS rouge1 FROM numbered LEFT JOIN f USING (id))"""
_SCORED = """s AS (SELECT doc_id, 'c' || (doc_id % 50) AS chunk_name, CASE WHEN doc_id % 11 > 0 THEN 'q' || doc_id END AS question, quality::VARCHAR AS answer,
    ((doc_id * 7919) % 20011) / 20011.0::DOUBLE AS se, ((doc_id * 104729) % 20011) / 20011.0::DOUBLE AS sn, ((doc_id * 1299709) % 20011) / 20011.0::DOUBLE AS sc FROM labels)"""

# The stand-in's answer: the first of the longest sentences of what follows the last "Text: " of its prompt.
_QA_GENERATE = rf"""WITH t AS (SELECT doc_id, regexp_replace(string_split(coalesce(text, ''), 'Text: ')[-1], '^\s+|\s+$', '', 'g') AS t FROM documents),
    s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM t),
    best AS (SELECT doc_id, list_filter(s, lambda x: length(x) = list_max(list_transform(s, lambda y: length(y))))[1] AS a FROM s),
    said AS (SELECT *, list_filter(list_transform(string_split('Answer: ' || a, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1] AS d FROM best)
    SELECT row_number() OVER (ORDER BY chunk_name) - 1 AS id, * FROM (SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_name, 'What is said about ' || array_to_string(list_filter(string_split_regex(a, '\s+'), lambda x: x <> '')[1:3], ' ') || '?' AS question,
        length(a)::INT AS n_answer, length(d)::INT AS n_declarative FROM said)"""

_TOKEN_MATCH = rf"""WITH {_PAIRS}, clipped AS (SELECT row_number() OVER () AS id, conv_id, turn, substr(regexp_replace(r, '^\s+|\s+$', '', 'g'), 1, 3000) AS r, substr(regexp_replace(g, '^\s+|\s+$', '', 'g'), 1, 3000) AS g FROM pairs),
    sides AS (SELECT id, 'r' AS side, r AS text FROM clipped UNION ALL SELECT id, 'g', g FROM clipped),
    tokens AS (SELECT id, side, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS token FROM sides),
    idf AS (SELECT token, ln(((SELECT count(*) FROM clipped) + 1) / (count(DISTINCT id) + 1.0)) AS idf FROM tokens WHERE side = 'r' GROUP BY token),
    counted AS (SELECT id, side, token, count(*) AS n, coalesce(max(idf), ln((SELECT count(*) FROM clipped) + 1.0)) AS w FROM tokens LEFT JOIN idf USING (token) GROUP BY id, side, token),
    vectors AS (SELECT token, list_transform(range(16), lambda i: len(list_filter(string_split(token, ''), lambda c: unicode(c) % 16 = i))::DOUBLE) AS v FROM (SELECT DISTINCT token FROM tokens)),
    units AS (SELECT token, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vectors),
    placed AS (SELECT counted.*, u FROM counted JOIN units USING (token)),
    best AS (SELECT a.id, a.side, a.token, a.n * a.w AS w, max(list_dot_product(a.u, b.u)) AS m FROM placed a JOIN placed b ON a.id = b.id AND a.side <> b.side GROUP BY a.id, a.side, a.token, a.n, a.w),
    scores AS (SELECT id, sum(CASE WHEN side = 'g' THEN w * m END) / sum(CASE WHEN side = 'g' THEN w END) AS p, sum(CASE WHEN side = 'r' THEN w * m END) / sum(CASE WHEN side = 'r' THEN w END) AS r FROM best GROUP BY id),
    sizes AS (SELECT id, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 'g') AS ng FROM tokens GROUP BY id)
    SELECT conv_id, turn, round(CASE WHEN coalesce(nr, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1 WHEN coalesce(nr, 0) = 0 OR coalesce(ng, 0) = 0 THEN 0 ELSE 2 * s.p * s.r / (s.p + s.r) END, 6)::DOUBLE AS f1
    FROM clipped c LEFT JOIN sizes USING (id) LEFT JOIN scores s USING (id)"""

ORACLES = {
    "exact_match": r"""SELECT conv_id, turn, (replace(trim(text, chr(10) || chr(9) || ' '), ' ', '') = replace(trim(CASE WHEN turn % 2 = 0 THEN ' ' || replace(text, ' ', '  ') || chr(10) ELSE role END, chr(10) || chr(9) || ' '), ' ', ''))::INT::DOUBLE AS em FROM conversations""",
    "rouge1": f"WITH {_ROUGE} SELECT conv_id, turn, round(rouge1, 6) AS rouge1 FROM scored",
    "qa_generate": _QA_GENERATE,
    "token_match": _TOKEN_MATCH,
    "metric_summary": f"""WITH {_ROUGE}, v AS (SELECT (replace(trim(r), ' ', '') = replace(trim(g), ' ', ''))::INT::DOUBLE AS em, rouge1 FROM scored)
        SELECT 'em' AS metric, round(avg(em), 6) AS average, round(stddev_samp(em), 6) AS std FROM v UNION ALL SELECT 'rouge1', round(avg(rouge1), 6), round(stddev_samp(rouge1), 6) FROM v""",
    "nli_select": f"WITH {_SCORED} SELECT doc_id, round(se, 6) AS score FROM s WHERE round(se, 4) >= 0.6",
    "nli_reject": f"WITH {_SCORED} SELECT doc_id, round(se, 6) AS score FROM s WHERE round(se, 4) < 0.6",
    "nli_final_intersect": f"""WITH {_SCORED} SELECT doc_id, chunk_name, question, answer FROM s a WHERE round(se, 4) >= 0.5 AND EXISTS (SELECT 1 FROM s b WHERE round(b.sn, 4) >= 0.5
        AND b.chunk_name = a.chunk_name AND b.question IS NOT DISTINCT FROM a.question AND b.answer IS NOT DISTINCT FROM a.answer)""",
    "nli_three_way": """SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'entailment' WHEN b >= c THEN 'neutral' ELSE 'contradiction' END AS label, round(greatest(exp(a), exp(b), exp(c)) / (exp(a) + exp(b) + exp(c)), 6) AS top
        FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)""",
    "nli_ratio": f"WITH {_SCORED} SELECT count(*) FILTER (round(se, 4) >= 0.6) AS selected, count(*) AS total, round(count(*) FILTER (round(se, 4) >= 0.6) / greatest(count(*), 1), 6) AS ratio FROM s",
    "qa_merge_ids": "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, conv_id, turn, length(text)::INT AS size FROM conversations WHERE role = 'user'",
    "qa_group_number": "SELECT conv_id, turn, role, n, 'conv' || conv_id || '_qa' || lpad(n::VARCHAR, 3, '0') || '.json' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)",
    "pair_hash": """WITH o AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i FROM documents)
        SELECT a.i // 2 AS pair, a.doc_id AS key_a, b.doc_id AS key_b FROM o a JOIN o b ON b.i = a.i + 1 WHERE a.i % 2 = 0 AND a.n >= 200 AND b.n >= 200""",
    "mcq_format": r"""WITH o AS (SELECT conv_id, turn, w, list_transform(w, lambda x, i: i || ') ' || x) AS o FROM (SELECT conv_id, turn, string_split(text, ' ')[1:5] AS w FROM conversations))
        SELECT conv_id, turn, CASE WHEN len(o) > 0 THEN 'Options:' || chr(10) || array_to_string(o, chr(10)) ELSE '' END AS block, len(o) = 5 AND (turn + 1)::VARCHAR IN ('1', '2', '3', '4', '5') AS valid FROM o""",
    "json_defaults": r"""WITH forms AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'so {"score": ' || printf('%.2f', (event_id % 150) / 100.0) || '} then' WHEN 1 THEN 'score: 0.25 I think' WHEN 2 THEN '{"score": ' WHEN 3 THEN '{"label": 1}'
            WHEN 4 THEN 'score is 10' WHEN 5 THEN 'score = 0.7' WHEN 6 THEN '{"label": 5, "score": 0.9}' ELSE '{"score": "x"} or "score": 0.6' END AS t FROM events),
        objects AS (SELECT event_id, t, regexp_extract(t, '\{.*?\}') AS o FROM forms),
        fields AS (SELECT event_id, t, CASE WHEN o <> '' THEN json_extract_string(o, '$.score') END AS s, CASE WHEN o <> '' THEN json_extract_string(o, '$.label') END AS l, o FROM objects),
        readable AS (SELECT *, o <> '' AND (s IS NULL OR try_cast(s AS DOUBLE) IS NOT NULL) AND (l IS NULL OR try_cast(l AS INT) IS NOT NULL) AS ok FROM fields),
        scored AS (SELECT event_id, ok, l, least(1.0, greatest(0.0, CASE WHEN ok THEN coalesce(try_cast(s AS DOUBLE), 0) ELSE coalesce(try_cast(nullif(regexp_extract(t, '([01](?:\.\d+)?)', 1), '') AS DOUBLE), 0) END))::DOUBLE AS score,
            least(1.0, greatest(0.0, CASE WHEN ok THEN coalesce(try_cast(s AS DOUBLE), 0) ELSE coalesce(try_cast(nullif(regexp_extract(t, '"score"\s*:\s*([01](?:\.\d+)?)', 1), '') AS DOUBLE), 0) END))::DOUBLE AS strict_score FROM readable)
        SELECT event_id, CASE WHEN ok AND l IS NOT NULL THEN (l = '1')::INT ELSE (score >= 0.5)::INT END AS label, round(score, 6) AS score,
            CASE WHEN ok AND l IS NOT NULL THEN (l = '1')::INT ELSE (strict_score >= 0.5)::INT END AS strict_label, round(strict_score, 6) AS strict_score FROM scored""",
    "useful_flags": "SELECT event_id, event_id % 4 IN (0, 3) AS is_useful FROM events",
    "gate_route": f"""WITH {_SCORED} SELECT doc_id, CASE WHEN se >= 0.8 THEN 'llm' WHEN doc_id % 13 = 0 THEN 'empty_context' WHEN sn <= 0.3 THEN 'fallback' WHEN sc >= 0.5 THEN 'rag' ELSE 'fallback' END AS route,
        CASE WHEN sn <= 0.3 THEN 'fallback' WHEN sc >= 0.5 THEN 'rag' ELSE 'fallback' END AS simple_route, CASE WHEN sn >= 0.6 THEN 'rag' ELSE 'fallback' END AS rerank_route FROM s""",
    "token_gate": """WITH h AS (SELECT vec_id, embedding[1:(vec_id % 33)]::DOUBLE[] AS a, embedding[33:(32 + vec_id % 3)]::DOUBLE[] AS b FROM embeddings),
        m AS (SELECT vec_id, coalesce(list_avg(a), 0) AS ma, coalesce(list_avg(b), 0) AS mb, CASE WHEN len(b) < 2 THEN 0 ELSE list_stddev_samp(b) END AS sb FROM h)
        SELECT vec_id, round(ma, 6) AS tok_mu_qc, round(mb, 6) AS tok_mu_q, round(sb, 6) AS tok_sigma_q, CASE WHEN (ma - mb) / (sb + 1e-6) >= 0.1 THEN 'rag' ELSE 'fallback' END AS route FROM m""",
    "iterative_answers": """WITH q AS (SELECT item_id AS qid, text AS q1, array_to_string(string_split(text, ' ')[1:12], ' ') AS q2 FROM benchmark)
        SELECT qid, CASE WHEN len(string_split(q1, ' ')) > 20 THEN 2 ELSE 1 END::INT AS rounds, CASE WHEN len(string_split(q1, ' ')) > 20 THEN q2 ELSE q1 END AS asked, reverse(CASE WHEN len(string_split(q1, ' ')) > 20 THEN q2 ELSE q1 END) AS generated FROM q""",
}
