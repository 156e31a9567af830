"""Gates that route a question to an answer, and iterative answering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import mean_std
from quern.workspace import materialize

EPSILON = 1e-6


def gate(know: Column | None, relevance: Column, faithfulness: Column, has_context: Column, know_at: float = 0.7, relevance_at: float = 0.7, faithfulness_at: float = 0.7) -> Column:
    """"llm" if the model knows (know >= know_at; skipped where know is None), which needs no context; else "empty_context" without context;
    "fallback" where the context is not relevant (relevance <= relevance_at); "rag" where the answer is faithful
    (faithfulness >= faithfulness_at); else "fallback"."""
    routed = F.when(~has_context, "empty_context") if know is None else F.when(know >= know_at, "llm").when(~has_context, "empty_context")
    return routed.when(relevance <= relevance_at, "fallback").when(faithfulness >= faithfulness_at, "rag").otherwise("fallback")


def rerank_gate(score: Column, threshold: float = 0.6, has_fallback: bool = True) -> Column:
    """"rag" if the reranker's score reaches the threshold or there is no fallback. Of a list of scores, pass the first."""
    return F.when(F.coalesce(score >= threshold, F.lit(False)), "rag").otherwise("fallback" if has_fallback else "rag")


def token_z(with_context: Column, without: Column) -> dict[str, Column]:
    """Mean log-probability with and without context, the latter's deviation, and how many of these they lie apart."""
    mean_with, _ = mean_std(with_context)
    mean_without, deviation = mean_std(without)
    return {"tok_mu_qc": mean_with, "tok_mu_q": mean_without, "tok_sigma_q": deviation, "tok_z_score": (mean_with - mean_without) / (deviation + F.lit(EPSILON))}


def token_gate(with_context: Column, without: Column, threshold: float = 0.1) -> Column:
    return F.when(token_z(with_context, without)["tok_z_score"] >= threshold, "rag").otherwise("fallback")


def answer_by_route(df: DataFrame, route_col: str, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row through the branch its route names, so that a model only sees the rows it must answer. Routes without a branch pass with a null answer."""
    parts = [branch(df.where(F.col(route_col) == name)) for name, branch in branches.items()]
    rest = df.where(~F.coalesce(F.col(route_col).isin(*branches), F.lit(False))).withColumn("generated", F.lit(None).cast("string"))
    for part in parts:
        rest = rest.unionByName(part, allowMissingColumns=True)
    return rest


def iterate(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], criticise: Callable[[DataFrame], DataFrame], max_iter: int = 3, question_col: str = "question") -> DataFrame:
    """Answer, criticise, ask again: questions with ``generated`` and ``rounds``.

    ``answer`` adds ``generated``; ``criticise`` adds ``critique`` (struct of iter_needed, new_query). Rows that need more go on with the
    new query (or the old one if it is blank), up to max_iter rounds; the question asked first is kept. Each round is written down.
    """
    active, done = questions.withColumn("asked", F.col(question_col)).withColumn("rounds", F.lit(0)), []
    for turn in range(1, max_iter + 1):
        judged = materialize(criticise(answer(active.drop("generated", "critique"))).withColumn("rounds", F.lit(turn)), "iterate")
        more = F.coalesce(F.col("critique.iter_needed"), F.lit(False))
        finished = judged if turn == max_iter else judged.where(~more)
        done.append(finished)
        if turn < max_iter:
            again = F.when(F.length(F.trim(F.coalesce(F.col("critique.new_query"), F.lit("")))) > 0, F.col("critique.new_query")).otherwise(F.col("asked"))
            active = judged.where(more).withColumn("asked", again)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("critique")
