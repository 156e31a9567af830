"""Question and answer records: numbering, pairing, shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern import models
from quern.functions.prompts import render
from quern.functions.text import lines_clean, unfence
from quern.workspace import materialize


def running_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """df with a dense id in the given order, without a window over all rows in one task: rows are dealt by range, numbered
    within their partition, and each partition adds the sizes of those before it."""
    numbered = running_sums(df.withColumn("__one", F.lit(1)), order, "__one", "__at")
    return numbered.withColumn(name, (F.col("__at") + start).cast("long")).drop("__one", "__at")


def running_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows before each in the given order, 0 for the first. Only one sum per partition goes to one task."""
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "running-sums")
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    earlier = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, earlier).join(before, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def number_groups(df: DataFrame, group: str, order: list[str], pattern: str = "%s_qa%03d.json") -> DataFrame:
    """df with ``n`` (from 1 within each group) and ``file_name``."""
    numbered = df.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))
    return numbered.withColumn("file_name", F.format_string(pattern, F.col(group).cast("string"), F.col("n")))


def hash_order(seed: int | str, key: Column) -> Column:
    """A reproducible shuffle: order by this."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")).cast("binary"))


def pair_up(df: DataFrame, seed: int, key: str, text: str, min_chars: int) -> DataFrame:
    """(pair, key_a, key_b, text_a, text_b): neighbours of the shuffled rows, two by two; an odd last row and pairs with a short text go."""
    shuffled = df.select(key, text, hash_order(seed, F.col(key)).alias("__h"))
    numbered = running_ids(shuffled, ["__h", key], 0, "__i").withColumn("pair", F.expr("__i div 2"))
    side = lambda column, which: F.max(F.when(F.col("__i") % 2 == which, F.col(column)))
    both = numbered.groupBy("pair").agg(*(side(c, w).alias(f"{n}_{'ab'[w]}") for c, n in ((key, "key"), (text, "text")) for w in (0, 1)), F.count(F.lit(1)).alias("__n"))
    return both.where((F.col("__n") == 2) & (F.length("text_a") >= min_chars) & (F.length("text_b") >= min_chars)).drop("__n")


def options_block(options: Column, header: str = "Options:\n") -> Column:
    """Options one a line under a header, or nothing."""
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.concat(F.lit(header), F.array_join(options, "\n"))).otherwise("")


def valid_choice(options: Column, answer: Column) -> Column:
    """Five options numbered "1) " to "5) " and a digit among them."""
    return F.coalesce((F.size(options) == 5) & F.forall(options, lambda o: o.rlike(r"^[1-5]\) ")) & answer.rlike(r"^[1-5]$"), F.lit(False))


def shape_question(df: DataFrame) -> DataFrame:
    """id, question, answer and ref_doc, missing ones empty."""
    have = set(df.columns)
    return df.select("id", "question", *((F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c) for c in ("answer", "ref_doc")))


def retrieved_items(docs: Column) -> Column:
    """array<struct<rel_path, rank, content array<string>>> from array<struct<rank, rel_path, content>>: contents as clean lines."""
    return F.transform(F.array_sort(docs), lambda d: F.struct(d["rel_path"].alias("rel_path"), d["rank"].alias("rank"), lines_clean(d["content"]).alias("content")))


def judge_scores(**scores: Column) -> Column:
    """The one-element list of scores that routed answers carry."""
    return F.array(F.struct(*(v.cast("double").alias(k) for k, v in scores.items())))


def shape_answer(kind: str, generated: Column, retrieved: Column | None = None, scores: Column | None = None, agent: str | None = None) -> list[Column]:
    """Output columns of an answer. kind: llm and sota carry no documents, the others do; the gated ones carry their scores."""
    kinds = {"llm": (False, False), "rag": (True, False), "router": (True, False), "gate_llm": (False, True), "gate_rag": (True, True), "gate_sota": (False, True), "sota": (False, False), "iter": (True, False)}
    documents, gated = kinds[kind]
    columns = [generated.alias("generated"), F.lit(agent or kind).alias("agent")]
    if documents and retrieved is not None:
        columns.append(retrieved_items(retrieved).alias("retrieved"))
    if gated and scores is not None:
        columns.append(scores.alias("judge_score"))
    return columns


def merge_prediction(result: Column, given: Column) -> Column:
    """The result's value, or the input's where that is null or empty."""
    return F.coalesce(F.nullif(result, F.lit("")), given)


def questions_from_chunks(chunks: DataFrame, model: models.ChatModel, max_qa: int | None = None) -> DataFrame:
    """(id, chunk_name, source_files, raw_chunk, md_summary, question, answer): a model writes a JSON list per chunk; chunks whose answer is no list give none. Ids run from 0 in order of chunk and place."""
    prompt = render("qa_single", source=F.array_join("source_files", ", "), summary=F.col("md_summary"), text=F.col("raw_chunk"))
    answers = chunks.withColumn("__a", F.from_json(unfence(models.column(model, prompt)), "array<struct<question:string,answer:string>>"))
    rows = answers.select("chunk_name", "source_files", "raw_chunk", "md_summary", F.posexplode("__a").alias("__at", "qa")).select("chunk_name", "source_files", "raw_chunk", "md_summary", "__at", "qa.question", "qa.answer").where("question is not null")
    numbered = running_ids(rows, ["chunk_name", "__at"]).drop("__at")
    numbered = numbered if max_qa is None else numbered.where(F.col("id") < max_qa)
    return numbered.select("id", "chunk_name", "source_files", "raw_chunk", "md_summary", "question", "answer")


def questions_from_pairs(pairs: DataFrame, model: models.ChatModel) -> DataFrame:
    """(id, question, answer, ref_name_a, ref_name_b, supporting_fact_a, supporting_fact_b). A pair takes as many ids as it has questions, or one if its answer cannot be read."""
    prompt = render("qa_multi", text_a=F.col("text_a"), text_b=F.col("text_b"))
    shape = "array<struct<question:string,answer:string,supporting_fact_a:string,supporting_fact_b:string>>"
    read = materialize(pairs.withColumn("__qa", F.from_json(unfence(models.column(model, prompt)), shape)), "pair-answers")
    taken = F.when(F.col("__qa").isNull(), 1).otherwise(F.size("__qa"))
    rows = running_sums(read.withColumn("__taken", taken), ["pair"], "__taken", "__first").select("__first", "key_a", "key_b", F.posexplode("__qa").alias("__at", "q"))
    return rows.select((F.col("__first") + F.col("__at")).cast("long").alias("id"), "q.question", "q.answer", F.col("key_a").alias("ref_name_a"), F.col("key_b").alias("ref_name_b"), "q.supporting_fact_a", "q.supporting_fact_b")


def choice_questions(chunks: DataFrame, model: models.ChatModel) -> DataFrame:
    """(id, chunk_name, question, options, answer, ref_doc): a model writes questions with five options per chunk; what breaks their form (valid_choice) goes.

    Ids run from 0 in order of chunk and place; ref_doc is the text of the right option. Chunks whose answer is no list give none.
    """
    shape = "array<struct<question: string, options: array<string>, answer: string>>"
    read = chunks.withColumn("__a", F.from_json(unfence(models.column(model, render("qa_choice", text=F.col("raw_chunk")))), shape))
    rows = read.select("chunk_name", F.posexplode("__a").alias("__at", "q")).select("chunk_name", "__at", "q.*")
    good = rows.where(F.length(F.trim(F.coalesce("question", F.lit("")))) > 0).where(valid_choice(F.col("options"), F.col("answer")))
    right = F.substring(F.get("options", F.col("answer").try_cast("int") - 1), 4, 1 << 30)
    return running_ids(good, ["chunk_name", "__at"]).select("id", "chunk_name", "question", "options", "answer", right.alias("ref_doc"))


def cited_questions(notebooks: DataFrame, model: models.ChatModel) -> DataFrame:
    """(id, notebook, question, sentences): a model writes questions over the notes of a notebook, whose answers are sentences with quotes.

    notebooks: notebook, notes (array of source and text). A sentence stays if it has quotes and each of them stands in the note of the source it names; a
    question stays with such a sentence. sentences: array of (sentence, reference: array of (source, text)). Ids run from 0 in order of notebook and place.
    """
    shape = "array<struct<question: string, answer: array<struct<sentence: string, reference: array<struct<source: string, text: string>>>>>>"
    listed = F.array_join(F.transform("notes", lambda n, i: F.concat((i + 1).cast("string"), F.lit(") "), F.coalesce(n["source"], F.lit("")), F.lit(": "), F.coalesce(n["text"], F.lit("")))), "\n")
    read = notebooks.withColumn("__a", F.from_json(unfence(models.column(model, render("qa_cited", notes=listed))), shape))
    rows = read.select("notebook", "notes", F.posexplode("__a").alias("__at", "q")).select("notebook", "notes", "__at", "q.question", "q.answer")
    stands = "exists(notes, n -> n.source = r.source and length(r.text) > 0 and contains(n.text, r.text))"
    kept = F.expr(f"filter(answer, s -> size(s.reference) > 0 and forall(s.reference, r -> coalesce({stands}, false)))")
    good = rows.withColumn("sentences", kept).where("size(sentences) > 0 and question is not null")
    return running_ids(good.drop("notes", "answer"), ["notebook", "__at"]).select("id", "notebook", "question", "sentences")


def with_declarative(qa: DataFrame, model: models.ChatModel) -> DataFrame:
    return qa.withColumn("declarative", models.column(model, render("declare", question=F.col("question"), answer=F.col("answer"))))
