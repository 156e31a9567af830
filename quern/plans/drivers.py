"""Whole flows: ingest, question making and filtering, answering, evaluation, requests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import models
from quern.functions import metrics
from quern.functions.prompts import render
from quern.functions.text import store_name
from quern.operators import filters, online, records, retrieval, routing, statistics
from quern.workspace import materialize

Chunker = Callable[[DataFrame], DataFrame]


def chunk_corpus(pages: DataFrame, chunkers: Mapping[str, Chunker], id_col: str = "rel_path") -> DataFrame:
    """Chunk records of every chunker, under its tag: (tag, rel_path, pos, chunk, id); ids run from 1 within a tag in order of page and place."""
    parts = None
    for tag, chunker in chunkers.items():
        numbered = records.running_ids(chunker(pages).select(id_col, "pos", "chunk"), [id_col, "pos"], 1).withColumn("tag", F.lit(tag))
        parts = numbered if parts is None else parts.unionByName(numbered)
    return parts


def build_indexes(rows: DataFrame, builders: Sequence[Callable[[DataFrame], object]], folder: Column) -> list[object]:
    """Each builder over rows with ``store``: the folder's name made safe."""
    named = filters.drop_blank(rows).withColumn("store", store_name(folder))
    return [build(named) for build in builders]


def dense_rows(rows: DataFrame, embed: Callable[[Column], Column] = models.hashed_embedding, text_col: str = "text") -> DataFrame:
    return rows.withColumn("embedding", embed(F.col(text_col)))


def make_questions(chunks: DataFrame, ask: models.ChatModel, declare: models.ChatModel, max_qa: int | None = None) -> DataFrame:
    """Question records with declaratives, numbered within their chunk for the sink."""
    made = records.with_declarative(records.questions_from_chunks(chunks, ask, max_qa), declare)
    return records.number_groups(made, "chunk_name", ["id"])


def filter_questions(qa: DataFrame, entail: Callable[[Column, Column], Column] = models.entailment_logits, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Selected and rejected records of both strategies, the final ones, and their ratio."""
    from quern.functions.vectors import softmax

    out: dict[str, DataFrame] = {}
    for strategy in ("CD", "QA"):
        scored = qa.withColumn("__l", entail(*filters.nli_premises(strategy))).withColumn("__p", softmax(F.col("__l"))).drop("__l")
        for i, name in enumerate(filters.CLASSES):
            scored = scored.withColumn(f"score_{name}", filters.rounded(F.get("__p", i)))
        out[f"{strategy}_selected"], out[f"{strategy}_rejected"] = filters.split_by(scored.withColumn("nli_class", filters.nli_class(F.col("__p"))).drop("__p"), filters.nli_keep(strategy, threshold))
    keys = ["chunk_name", "question", "answer"]
    out["final"] = filters.null_safe_semi(out["CD_selected"], out["QA_selected"], keys)
    total = qa.agg(F.count(F.lit(1)).alias("total"))
    out["ratio"] = out["final"].agg(F.count(F.lit(1)).alias("selected")).join(total, how="cross").withColumn("ratio", F.col("selected") / F.greatest("total", F.lit(1)))  # one row each
    return out


def rerank(found: DataFrame, questions: DataFrame, contents: DataFrame, score: models.PairModel = models.overlap_scorer) -> DataFrame:
    """found (qid, rank, doc, ...) with ``rerank_score`` of question and content and ``rank`` anew; ties keep their order."""
    from pyspark.sql import Window as W

    rows = found.withColumnRenamed("rank", "__old").join(questions, "qid").join(contents, "doc")
    scored = rows.withColumn("rerank_score", models.pair_column(score, F.col("question"), F.col("content")))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rerank_score"), "__old"))).drop("__old", "question", "content")


def answer_batch(contexts: DataFrame, chat: models.ChatModel, fallback: models.ChatModel, know: models.PairModel | None = None, relevance: models.PairModel = models.overlap_scorer, faithful: models.PairModel = models.overlap_scorer, know_at: float = 0.7, relevance_at: float = 0.7, faithfulness_at: float = 0.7) -> DataFrame:
    """contexts (qid, question, context) with ``route``, ``generated`` and ``judge_score``, stage by stage; a model sees only the rows that its stage needs.

    What the model knows is answered without context. Of the rest, rows with context are answered from it, then judged for relevance, and
    relevant ones for faithfulness. Scores of stages that a row did not reach are null. Each stage is written down, so that no model runs twice.
    """
    question, context, draft = F.col("question"), F.col("context"), F.col("draft")
    empty = lambda kind: F.lit(None).cast(kind)
    plain = render("answer", question=question)
    known = empty("double") if know is None else models.pair_column(know, question, question)
    asked = contexts.withColumn("know_prob", known)
    asked = asked if know is None else materialize(asked, "answers-known")
    knows = F.coalesce(F.col("know_prob") >= know_at, F.lit(False))
    has = F.length(F.trim(F.coalesce(context, F.lit("")))) > 0
    drafted = asked.where(~knows & has).withColumn("draft", models.column(chat, render("answer_context", context=context, question=question)))
    related = materialize(drafted.withColumn("relv_score", models.pair_column(relevance, question, context)), "answers-related")
    relevant = F.coalesce(F.col("relv_score") > relevance_at, F.lit(False))
    checked = materialize(related.where(relevant).withColumn("faith_score", models.pair_column(faithful, context, draft)), "answers-checked")
    faithful_enough = F.coalesce(F.col("faith_score") >= faithfulness_at, F.lit(False))
    by_fallback = lambda rows: rows.withColumn("route", F.lit("fallback")).withColumn("generated", models.column(fallback, plain))
    parts = [
        asked.where(knows).withColumn("route", F.lit("llm")).withColumn("generated", models.column(chat, plain)),
        asked.where(~knows & ~has).withColumn("route", F.lit("empty_context")).withColumn("generated", empty("string")),
        by_fallback(related.where(~relevant).drop("draft")),
        checked.where(faithful_enough).withColumn("route", F.lit("rag")).withColumnRenamed("draft", "generated"),
        by_fallback(checked.where(~faithful_enough).drop("draft")),
    ]
    scores = ("know_prob", "relv_score", "faith_score")
    parts = [p.select(*contexts.columns, "route", "generated", records.judge_scores(**{s: F.col(s) if s in p.columns else empty("double") for s in scores}).alias("judge_score")) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def answer_by_tokens(contexts: DataFrame, chat: models.ScoredModel, fallback: models.ChatModel, threshold: float = 0.1) -> DataFrame:
    """contexts (qid, question, context) answered twice, with and without context, by a model that tells the log-probabilities of its tokens; the gate on
    both sets of them keeps the answer from context or asks the fallback. Adds route, generated, logprobs and token statistics."""
    question, context = F.col("question"), F.col("context")
    both = contexts.withColumn("__c", models.scored_column(chat, render("answer_context", context=F.coalesce(context, F.lit("")), question=question))).withColumn("__p", models.scored_column(chat, render("answer", question=question)))
    both = materialize(both, "answers-tokens")
    told = both.select(*contexts.columns, "__c", *(v.alias(k) for k, v in routing.token_z(F.col("__c.logprobs"), F.col("__p.logprobs")).items()), routing.token_gate(F.col("__c.logprobs"), F.col("__p.logprobs"), threshold).alias("route"))
    kept = told.where("route = 'rag'").withColumn("generated", F.col("__c.text"))
    asked = told.where("route <> 'rag'").withColumn("generated", models.column(fallback, render("answer", question=question)))
    return kept.unionByName(asked).withColumn("logprobs", F.col("__c.logprobs")).drop("__c")


@dataclass(frozen=True)
class QuestionType:
    """How a kind of question is answered: what of its rows is taken, the prompt made of that, and the columns of the result.

    Kinds are put together from parts, by_context = QuestionType(prompt).giving(...), in place of a function for every combination.
    """

    prompt: Callable[[DataFrame], Column]
    inputs: Callable[[DataFrame], DataFrame] = lambda rows: rows
    outputs: Callable[[Column], Sequence[Column]] = lambda answer: records.shape_answer("llm", answer)

    def taking(self, inputs: Callable[[DataFrame], DataFrame]) -> QuestionType:
        return replace(self, inputs=inputs)

    def giving(self, outputs: Callable[[Column], Sequence[Column]]) -> QuestionType:
        return replace(self, outputs=outputs)

    def answer(self, rows: DataFrame, model: models.ChatModel) -> DataFrame:
        """The rows taken, with the result's columns; the model sees each prompt once."""
        taken = self.inputs(rows)
        answered = taken.withColumn("__answer", models.column(model, self.prompt(taken)))
        return answered.select(*taken.columns, *self.outputs(F.col("__answer")))


METRICS = ("recall", "mrr", "sbert", "rouge1", "rougeL", "em")


def evaluate(results: DataFrame, embed: Callable[[Column], Column] = models.hashed_embedding, extra: Mapping[str, models.PairModel] | None = None, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores per row, summary) of results (id, reference, generated, ref_docs, gen_docs): all metrics, or those named, in one pass.

    ``extra`` names further models of pairs. A name of no metric is an error.
    """
    unknown = set(names or ()) - {*METRICS, *(extra or {})}
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    a, b = F.col("reference"), F.col("generated")
    rows = results.withColumn("__a", embed(a)).withColumn("__b", embed(b))
    scores = {
        "recall": metrics.recall_hit(F.col("ref_docs"), F.col("gen_docs")), "mrr": metrics.reciprocal_rank(F.col("ref_docs"), F.col("gen_docs")), "sbert": metrics.embedding_similarity(a, b, F.col("__a"), F.col("__b")),
        "rouge1": metrics.rouge1(a, b), "rougeL": metrics.rouge_l(a, b), "em": metrics.exact_match(a, b),
    } | {name: models.pair_column(model, a, b) for name, model in (extra or {}).items()}
    scores = {k: v for k, v in scores.items() if names is None or k in names}
    scored = rows.select("id", *(v.alias(k) for k, v in scores.items()))
    return scored, statistics.summarize(scored, list(scores))


def enrich_requests(requests: DataFrame, series: Mapping[str, DataFrame], keys: Sequence[str] = ("farm_cd", "house_cd"), order: Sequence[str] = ("ts",)) -> DataFrame:
    """requests with the latest row of each series as a struct of its name; null where there is none."""
    out = requests
    for name, rows in series.items():
        fields = [c for c in rows.columns if c not in keys]
        latest = online.latest_row(rows, keys, order, fields)
        out = out.join(latest.select(*keys, F.struct(*fields).alias(name)), list(keys), "left")
    return out


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests (query_rag, farm_cd, house_cd, basetime) with ``response``: faulty ones get an error, the others what ``answer`` adds as ``generated``."""
    checked = requests.withColumn("__c", online.check_request(F.col("query_rag"), F.col("farm_cd"), F.col("house_cd"), F.col("basetime"))).withColumn("mode", F.col("__c.mode"))
    good = answer(checked.where(F.col("__c.status") == "S"))
    bad = checked.where(F.col("__c.status") != "S").withColumn("generated", F.lit(None).cast("string"))
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.withColumn("response", online.response(F.col("__c.status"), F.col("__c.message"), F.col("generated"))).drop("__c")
