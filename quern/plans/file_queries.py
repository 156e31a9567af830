"""Queries that write the pipelines' files from the tables and read them again, and whole flows over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import models
from quern.functions import judging, metrics
from quern.functions.prompts import TEMPLATES, answering, render
from quern.functions.text import sentences
from quern.operators import chunking, filters, records, statistics
from quern.plans import drivers
from quern.plans.answer_queries import _PAIRS, _pairs
from quern.plans.text_queries import _FIXED_SQL, _SENTENCES_SQL
from quern.session import table
from quern.sources import scans, sinks
from quern.workspace import fresh_path

PER_FILE = 100


def _arrays(rows: DataFrame, number: str, name: str, *fields: str) -> DataFrame:
    """(rel_path, text): JSON arrays of PER_FILE records by number, null fields left out, in files "<name>_<n>.json"."""
    part = F.expr(f"{number} div {PER_FILE}")
    listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("__n"), F.struct(*fields).alias("r"))))
    grouped = rows.groupBy(part.alias("__f")).agg(F.to_json(F.transform(listed, lambda x: x["r"])).alias("text"))
    return grouped.select(F.format_string(f"{name}_%06d.json", "__f").alias("rel_path"), "text")


def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records written as files of JSON arrays, read again and numbered anew; those without a question go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("%s#%d", "lang", "doc_id").alias("chunk_name"), F.when(F.col("n_chars") > 300, F.concat(F.lit("About "), "source")).alias("question"), F.substring("text", 1, 40).alias("answer"))
    folder = fresh_path(spark, "question-files")
    sinks.write_files(_arrays(docs, "doc_id", "qa", "chunk_name", "question", "answer"), folder)
    return scans.qa_files(spark, folder).select("id", "chunk_name", "question", "answer", F.element_at(F.split("path", "/"), -1).alias("file"))


def chunk_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk records numbered over the corpus, written as files, read again with what an index keeps of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("raw_chunk"), F.array("source", "lang").alias("source_files"))
    numbered = sinks.chunk_records(docs, ["doc_id", "pos"], "whole")
    folder = fresh_path(spark, "chunk-files")
    sinks.write_files(_arrays(numbered, "id", "whole", "id", "source_files", "raw_chunk"), folder)
    return scans.chunk_files(spark, folder).select("id", "chunk_id", "original_id", "source_list", F.length("raw_chunk").alias("n_chars"))


def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in their output shape, with documents and scores, written as files and read again."""
    pairs = _pairs(spark, sf_dir).withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    found = F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("d"), "turn").alias("rel_path"), F.col("reference").alias("content")))
    shaped = pairs.select("n", F.col("n").alias("id"), F.col("reference").alias("question"), *records.shape_answer("gate_rag", F.col("generated"), found, records.judge_scores(relv_score=F.col("turn") / 4)))
    folder = fresh_path(spark, "prediction-files")
    sinks.write_files(_arrays(shaped, "n", "answers", "id", "question", "generated", "agent", "retrieved", "judge_score"), folder)
    read = scans.prediction_files(spark, folder)
    first = F.get("retrieved", 0)
    return read.select("id", "question", "generated", "agent", first["rel_path"].alias("rel_path"), F.size(first["content"]).alias("n_lines"), F.get("judge_score", 0)["relv_score"].alias("relv_score"), "result_file")


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by setting as a CSV file, read as a score table."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("setting"), F.col("l_linenumber").cast("string").alias("qid"))
    mean = lambda c: F.round(F.avg(F.round(F.col(c) * 100).cast("long")) + F.lit(1e-9), 4)
    scores = lines.agg(mean("l_quantity").alias("bertscore"), mean("l_tax").alias("sbert"), mean("l_discount").alias("rouge1"), F.max(F.when(F.col("l_linenumber") > 3, 1.5)).alias("rougeL"))
    folder = fresh_path(spark, "score-files")
    sinks.write_csv(scores, folder)
    return scans.score_table(spark, folder)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _pairs(spark, sf_dir).select(metrics.exact_match(F.col("reference"), F.col("generated")).alias("em"), metrics.rouge1(F.col("reference"), F.col("generated")).alias("rouge1"))
    return statistics.summarize(scored, ["em", "rouge1"]).select("metric", F.round("average", 6).alias("average"), F.round("std", 6).alias("std"))


def summary_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and deviations as sheets with a column per metric, one under the other."""
    averages, deviations = sinks.summary_sheets(_summary(spark, sf_dir))
    return averages.withColumn("sheet", F.lit("average")).unionByName(deviations.withColumn("sheet", F.lit("std")))


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric's rows beside the texts it was taken from, written as JSON lines by agent and read again."""
    pairs = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "reference", "generated")
    scored = pairs.select("id", F.round(metrics.rouge1(F.col("reference"), F.col("generated")), 6).alias("rouge1"))
    rows = sinks.metric_rows(scored, pairs, "rouge1").withColumn("agent", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    folder = fresh_path(spark, "metric-files")
    sinks.write_records(rows, folder, "agent")
    return spark.read.schema("id long, rouge1 double, reference string, generated string, agent string").json(folder)


def chunk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of each chunk: that of the first chunk file whose name begins with the chunk's own less its number."""
    docs = table(spark, sf_dir, "documents")
    files = docs.where("n_chars > 400").select(F.concat_ws("_", "lang", "source", F.expr("doc_id % 17")).alias("stem"), F.concat_ws("/", "lang", "source").alias("folder"))
    chunks = docs.select("doc_id", F.concat_ws("_", "lang", "source", F.expr("doc_id % 19"), F.lit("qa001")).alias("chunk_name"))
    return sinks.group_folder(chunks, files).select("doc_id", "chunk_name", "folder")


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunkers over the corpus, their records numbered each from 1."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "text")
    by_sentence = lambda p: p.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "chunk"))
    found = drivers.chunk_corpus(pages, {"fixed": lambda p: chunking.fixed_size(p, size=64, overlap=50), "sentence": by_sentence}, "doc_id")
    return found.select("tag", "id", "doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("md5"))


def request_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the latest reading of two series of their user; users without one stay."""
    events = table(spark, sf_dir, "events")
    series = lambda kind: events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id", "value")
    asked = events.select("user_id").unionByName(table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("user_id"))).distinct()
    found = drivers.enrich_requests(asked, {"error": series("error"), "view": series("view")}, ["user_id"], ["ts", "event_id"])
    return found.select("user_id", F.col("error.event_id").alias("error_id"), F.col("view.event_id").alias("view_id"), F.col("view.value").alias("view_value"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each dialogue turn, slots in values left as they are, null ones empty."""
    turns = table(spark, sf_dir, "conversations")
    context = F.when(F.col("turn") % 3 > 0, F.concat(F.lit("{question}"), "role"))
    return turns.select("conv_id", "turn", F.md5(render("answer_context", context=context, question=F.col("text")).cast("binary")).alias("context_md5"), F.md5(render("faithfulness", text=F.col("text"), answer=F.col("role")).cast("binary")).alias("faith_md5"))


def answer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered stage by stage: known ones, those without context, irrelevant ones, unfaithful and faithful answers."""
    pairs = _pairs(spark, sf_dir)
    known = F.when(F.col("conv_id") % 5 > 0, F.col("generated")).otherwise(F.lit(" "))
    contexts = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.substring("reference", 1, 120).alias("question"), known.alias("context"))
    knows = lambda a, b: pd.Series([float(len(x or "") % 10) / 10 for x in a])
    answered = drivers.answer_batch(contexts, models.echo_model, models.echo_model, knows, knows_at_all(), knows_at_all(), know_at=0.8, relevance_at=0.05, faithfulness_at=0.05)
    score = F.get("judge_score", 0)
    return answered.select("qid", "route", "generated", F.round(score["know_prob"], 6).alias("know_prob"), F.round(score["relv_score"], 6).alias("relv_score"), F.round(score["faith_score"], 6).alias("faith_score"))


def knows_at_all() -> models.PairModel:
    """Share of the shorter text's different words that the longer one has."""

    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = [(set((x or "").split(" ")) - {""}, set((y or "").split(" ")) - {""}) for x, y in zip(a, b)]
        return pd.Series([len(x & y) / min(len(x), len(y)) if x and y else 0.0 for x, y in sets], dtype=float)

    return share


def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's label and score of each document for its claim, from what it says: an object, a bare number, neither."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("says "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"score": 0.'), (F.col("conv_id") % 10).cast("string"), F.lit("}"))).when(F.col("turn") % 3 == 1, "0.75 at most").otherwise("nothing")).alias("claim"))
    found = judging.judge_batch(turns, models.echo_model, "faith", F.col("role"), F.col("claim"))
    return found.select("conv_id", "turn", "pred_label", F.round("prob", 6).alias("prob"), "used_chunk", F.size("support").alias("n_support"))


def question_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input shape of questions, pairs that are long enough, and the first of them by name."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 50).alias("question"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("answer"), "text")
    kept = records.shape_question(docs.where(filters.long_enough(F.col("text"), F.col("question"), 50)).drop("text"))
    stores = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionByName(table(spark, sf_dir, "documents").select(F.col("lang").alias("name"))).distinct()
    first = sorted(r["name"] for r in filters.limit_first(stores, ["name"], 3).collect())
    return kept.withColumn("stores", F.lit(",".join(first)))


def qa_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with five options from all documents by the stand-in model, those in good form."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("d%08d", "doc_id").alias("chunk_name"), F.col("text").alias("raw_chunk"))
    return records.choice_questions(docs, models.choice_model).select("id", "chunk_name", F.array_join("options", "|").alias("options"), "answer", "ref_doc")


def qa_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the first lines of four documents each, answers quoting them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("n%08d", F.expr("doc_id div 4")).alias("notebook"), F.concat(F.lit("doc"), "doc_id").alias("source"), F.trim(F.substring_index("text", "\n", 1)).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", F.struct("source", "text").alias("n"))))
    notebooks = docs.where("text <> ''").groupBy("notebook").agg(F.transform(listed, lambda x: x["n"]).alias("notes"))
    found = records.cited_questions(notebooks, models.quoting_model)
    return found.select("id", "notebook", F.size("sentences").alias("n_sentences"), F.array_join(F.transform("sentences", lambda s: F.concat(F.get(s["reference"], 0)["source"], F.lit("="), F.get(s["reference"], 0)["text"])), "|").alias("quotes"))


def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each turn by whether it has a context and options, in two languages."""
    turns = table(spark, sf_dir, "conversations")
    context, options = F.when(F.col("turn") % 2 == 0, F.col("role")), F.when(F.col("conv_id") % 3 == 0, "1) a\n2) b").when(F.col("conv_id") % 3 == 1, " ")
    md5 = lambda c: F.md5(c.cast("binary"))
    return turns.select("conv_id", "turn", md5(answering(F.col("text"), context, options)).alias("plain"), md5(answering(F.col("text"), context, options, "ko")).alias("korean"))


QUERIES = {f.__name__: f for f in (qa_choice, qa_cited, answer_prompts, question_files, chunk_record_files, prediction_records, score_files, summary_sheets, metric_files, chunk_folders, corpus_chunks, request_readings, prompt_texts, answer_routes, judged_claims, question_shapes)}


def _prompt(name: str, **slots: str) -> str:
    """SQL for a template with expressions in its slots."""
    parts, rest = [], TEMPLATES[name]
    for slot, value in sorted(slots.items(), key=lambda s: rest.index("{" + s[0] + "}")):
        head, _, rest = rest.partition("{" + slot + "}")
        parts += ["'" + head.replace("'", "''") + "'", f"coalesce({value}, '')"]
    return " || ".join([*parts, "'" + rest.replace("'", "''") + "'"]).replace("\n", "' || chr(10) || '")


_WORD_SET = "list_distinct(list_filter(string_split({t}, ' '), lambda x: x <> ''))"


def _share(a: str, b: str) -> str:
    x, y = _WORD_SET.format(t=a), _WORD_SET.format(t=b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END"


_ROUGE_SUMMARY = """(SELECT (replace(trim(r), ' ', '') = replace(trim(g), ' ', ''))::INT::DOUBLE AS em, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 OR common = 0 THEN 0.0
        ELSE 2.0 * (common / len(b)) * (common / len(a)) / (common / len(b) + common / len(a)) END AS rouge1, conv_id, turn, r, g FROM (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0)::DOUBLE AS common
        FROM (SELECT *, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(g, '\\s+'), lambda x: x <> '') AS b FROM pairs)))"""

_KINDS = lambda tag: "CASE " + " ".join(
    f"WHEN {test} THEN {_prompt(name, **{slot: value for slot, value in _SLOTS.items() if '{' + slot + '}' in TEMPLATES[name]})}"
    for test, name in (("turn % 2 = 0 AND conv_id % 3 = 0", f"answer_context_choice{tag}"), ("conv_id % 3 = 0", f"answer_choice{tag}"), ("turn % 2 = 0", f"answer_context{tag}"), ("true", f"answer{tag}"))
) + " END"
_SLOTS = {"context": "role", "question": "text", "options": "('1) a' || chr(10) || '2) b')"}

ORACLES = {
    "qa_choice": r"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_name, array_to_string(o, '|') AS options, (n % 6)::VARCHAR AS answer, w[n % 6] AS ref_doc
        FROM (SELECT doc_id, length(text) AS n, w, list_transform(range(1, 6), lambda i: i || ') ' || w[i]) AS o FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 5) WHERE n % 6 > 0""",
    "qa_cited": """WITH n AS (SELECT doc_id, 'n' || lpad((doc_id // 4)::VARCHAR, 8, '0') AS notebook, trim(string_split(text, chr(10))[1]) AS t FROM documents)
        SELECT row_number() OVER (ORDER BY notebook) - 1 AS id, notebook, count(*)::INT AS n_sentences, string_agg('doc' || doc_id || '=' || substr(t, 1, 20), '|' ORDER BY doc_id) AS quotes FROM n WHERE t <> '' GROUP BY notebook""",
    "answer_prompts": f"SELECT conv_id, turn, md5({_KINDS('')}) AS plain, md5({_KINDS('@ko')}) AS korean FROM conversations",
    "question_files": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, lang || '#' || doc_id AS chunk_name, 'About ' || source AS question, substr(text, 1, 40) AS answer, 'qa_' || lpad((doc_id // {PER_FILE})::VARCHAR, 6, '0') || '.json' AS file
        FROM documents WHERE n_chars > 300""",
    "chunk_record_files": rf"""SELECT id, 'whole_' || lpad((id // {PER_FILE})::VARCHAR, 6, '0') || '__c001' AS chunk_id, id::VARCHAR AS original_id, source || ', ' || lang AS source_list, length(text)::INT AS n_chars
        FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM documents) WHERE regexp_matches(text, '\S')""",
    "prediction_records": rf"""WITH {_PAIRS} SELECT conv_id * 1000 + turn AS id, r AS question, g AS generated, 'gate_rag' AS agent, 'd' || turn AS rel_path, len(list_filter(string_split(r, chr(10)), lambda x: regexp_matches(x, '\S')))::INT AS n_lines,
        turn / 4 AS relv_score, 'answers_' || lpad(((conv_id * 1000 + turn) // {PER_FILE})::VARCHAR, 6, '0') || '.json' AS result_file FROM pairs""",
    "score_files": """SELECT l_returnflag AS setting, l_linenumber::VARCHAR AS qid, round(avg(round(l_quantity * 100)::BIGINT) + 1e-9, 4) AS bertscore, round(avg(round(l_tax * 100)::BIGINT) + 1e-9, 4) AS sbert, round(avg(round(l_discount * 100)::BIGINT) + 1e-9, 4) AS rouge1,
        CASE WHEN l_linenumber > 3 THEN 1.5::DOUBLE END AS "rougeL" FROM lineitem GROUP BY l_returnflag, l_linenumber""",
    "summary_sheets": f"WITH {_PAIRS}, v AS {_ROUGE_SUMMARY} SELECT round(avg(em), 6) AS em, round(avg(rouge1), 6) AS rouge1, 'average' AS sheet FROM v UNION ALL SELECT round(coalesce(stddev_samp(em), 0), 6), round(coalesce(stddev_samp(rouge1), 0), 6), 'std' FROM v",
    "metric_files": f"WITH {_PAIRS}, v AS {_ROUGE_SUMMARY} SELECT conv_id * 1000 + turn AS id, round(rouge1, 6) AS rouge1, r AS reference, g AS generated, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN 'even' ELSE 'odd' END AS agent FROM v",
    "chunk_folders": """WITH files AS (SELECT DISTINCT lang || '_' || source || '_' || (doc_id % 17) AS stem, lang || '/' || source AS folder FROM documents WHERE n_chars > 400),
        chunks AS (SELECT doc_id, lang || '_' || source || '_' || (doc_id % 19) || '_qa001' AS chunk_name, lang || '_' || source || '_' || (doc_id % 19) AS p FROM documents),
        found AS (SELECT p, arg_min(folder, (stem, folder)) AS folder FROM (SELECT DISTINCT p FROM chunks) JOIN files ON starts_with(stem, p) GROUP BY p)
        SELECT doc_id, chunk_name, coalesce(folder, '.') AS folder FROM chunks LEFT JOIN found USING (p)""",
    "corpus_chunks": f"""WITH fixed AS ({_FIXED_SQL}), sentence AS (SELECT doc_id, (i - 1)::INT AS pos, trim(s[i]) AS chunk FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES_SQL} AS s FROM documents)))
        SELECT 'fixed' AS tag, row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, md5(chunk) AS md5 FROM fixed UNION ALL SELECT 'sentence', row_number() OVER (ORDER BY doc_id, pos), doc_id, pos, md5(chunk) FROM sentence""",
    "request_readings": """WITH asked AS (SELECT DISTINCT user_id FROM events UNION SELECT -c_custkey FROM customer),
        e AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS error_id FROM events WHERE event_type = 'error' GROUP BY user_id),
        v AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS view_id, arg_max(value, (ts, event_id)) AS view_value FROM events WHERE event_type = 'view' GROUP BY user_id)
        SELECT user_id, error_id, view_id, view_value FROM asked LEFT JOIN e USING (user_id) LEFT JOIN v USING (user_id)""",
    "prompt_texts": f"""SELECT conv_id, turn, md5({_prompt("answer_context", context="CASE WHEN turn % 3 > 0 THEN '{question}' || role END", question="text")}) AS context_md5,
        md5({_prompt("faithfulness", text="text", answer="role")}) AS faith_md5 FROM conversations""",
    "answer_routes": f"""WITH {_PAIRS}, c AS (SELECT conv_id * 1000 + turn AS qid, substr(r, 1, 120) AS question, CASE WHEN conv_id % 5 > 0 THEN g ELSE ' ' END AS context FROM pairs),
        known AS (SELECT *, (length(question) % 10) / 10 AS know, list_filter(list_transform(string_split('Answer the question.' || chr(10) || question, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] AS plain,
            list_filter(list_transform(string_split('Question: ' || question, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] AS draft FROM c),
        related AS (SELECT *, CASE WHEN know < 0.8 AND trim(context) <> '' THEN {_share("question", "context")} END AS relv FROM known),
        checked AS (SELECT *, CASE WHEN relv > 0.05 THEN {_share("context", "draft")} END AS faith FROM related)
        SELECT qid, CASE WHEN know >= 0.8 THEN 'llm' WHEN trim(context) = '' THEN 'empty_context' WHEN relv <= 0.05 OR faith < 0.05 THEN 'fallback' ELSE 'rag' END AS route,
            CASE WHEN know >= 0.8 THEN plain WHEN trim(context) = '' THEN NULL WHEN relv <= 0.05 OR faith < 0.05 THEN plain ELSE draft END AS generated,
            round(know, 6)::DOUBLE AS know_prob, round(relv, 6)::DOUBLE AS relv_score, round(faith, 6)::DOUBLE AS faith_score FROM checked""",
    "judged_claims": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN (conv_id % 10 >= 5)::INT WHEN 1 THEN 1 ELSE 0 END AS pred_label, CASE turn % 3 WHEN 0 THEN (conv_id % 10) / 10 WHEN 1 THEN 0.75 ELSE 0 END::DOUBLE AS prob, role AS used_chunk, 1 AS n_support FROM conversations""",
    "question_shapes": """SELECT doc_id AS id, substr(text, 1, 50) AS question, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS answer, '' AS ref_doc,
        (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM (SELECT source AS name FROM documents UNION SELECT lang FROM documents) ORDER BY name LIMIT 3)) AS stores FROM documents WHERE length(text) >= 50""",
}
