"""Reading what models answer: JSON with defaults, judge scores, iteration critics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.prompts import render
from quern.functions.text import unfence
from quern.models import ChatModel
from quern.models import column as model_column


def flag(response: Column, name: str = "is_useful") -> Column:
    """A boolean field of a JSON answer: false where it is missing, true where the answer cannot be read (a failed call drops nothing)."""
    parsed = F.try_parse_json(unfence(response))
    return F.when(parsed.isNull() | F.coalesce(F.schema_of_variant(parsed) == "VOID", F.lit(False)), True).otherwise(F.coalesce(F.try_variant_get(parsed, f"$.{name}", "boolean"), F.lit(False)))


# What is read as an object, and as a score where no object can be read (any judge; careful judges).
FIRST_OBJECT = r"(?s)\{.*?\}"
ANY_NUMBER = r"([01](?:\.\d+)?)"
NAMED_NUMBER = r'"score"\s*:\s*([01](?:\.\d+)?)'


def judge(response: Column, loose: bool = True) -> Column:
    """struct<label int, score double> of a judge's answer.

    The first {...} gives score (clamped to 0..1, default 0) and label (1 if it says 1, else 0; default: score at least 0.5). Where there is none, or
    one of the two is no number, the first 0 or 1 with its decimals counts if ``loose``, else only one behind "score":. Otherwise (0, 0).
    """
    text = F.coalesce(response, F.lit(""))
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(text, FIRST_OBJECT, 0), F.lit("")))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    given, number = F.try_variant_get(parsed, "$.score", "variant"), F.try_variant_get(parsed, "$.score", "double")
    named, label = F.try_variant_get(parsed, "$.label", "variant"), F.try_variant_get(parsed, "$.label", "int")
    read = parsed.isNotNull() & (given.isNull() | number.isNotNull()) & (named.isNull() | label.isNotNull())
    bare = F.nullif(F.regexp_extract(text, ANY_NUMBER if loose else NAMED_NUMBER, 1), F.lit("")).try_cast("double")
    score = F.when(read, unit(F.coalesce(number, F.lit(0.0)))).otherwise(unit(F.coalesce(bare, F.lit(0.0))))
    said = F.when(read & label.isNotNull(), (label == 1).cast("int")).otherwise((score >= 0.5).cast("int"))
    return F.struct(said.alias("label"), score.alias("score"))


def judge_batch(rows: DataFrame, model: ChatModel, kind: str, doc: Column, claim: Column, loose: bool = True) -> DataFrame:
    """rows with pred_label, prob, used_chunk and support (array of one score): a judge model's view of each claim against its document.

    kind: "relv" (is the document relevant to the question?) or "faith" (does it support the answer?). Rows pair documents with claims, so their
    numbers cannot differ.
    """
    prompts = {"relv": lambda: render("relevance", question=claim, text=doc), "faith": lambda: render("faithfulness", text=doc, answer=claim)}
    if kind not in prompts:
        raise ValueError(f"unknown kind of judgement: {kind}")
    answer = model_column(model, prompts[kind]())
    judged = rows.withColumn("__j", judge(answer, loose))
    return judged.withColumn("pred_label", F.col("__j.label")).withColumn("prob", F.col("__j.score")).withColumn("used_chunk", doc).withColumn("support", F.array("__j.score")).drop("__j")


def critic(response: Column) -> Column:
    """struct<iter_needed boolean, new_query string> from the first element of a JSON array; none needed if it cannot be read."""
    first = F.get(F.from_json(unfence(response), "array<struct<iter_needed:boolean,new_query:string>>"), 0)
    return F.struct(F.coalesce(first["iter_needed"], F.lit(False)).alias("iter_needed"), first["new_query"].alias("new_query"))


def interpretation(response: Column) -> Column:
    """struct<crop, modelType[], task[], keyword[]> of a query; empty parts where the answer cannot be read."""
    read = F.from_json(unfence(response), "crop string, modelType array<string>, task array<string>, keyword array<string>")
    none = F.expr("CAST(array() AS array<string>)")
    return F.struct(F.coalesce(read["crop"], F.lit("")).alias("crop"), *(F.coalesce(read[n], none).alias(n) for n in ("modelType", "task", "keyword")))
