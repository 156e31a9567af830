"""Text expressions whose white space is that of Unicode, not only the blank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_ENDS = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """body(value), the value computed once even where a lambda inside the body names it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, SPACE_ENDS, "")


def is_blank(x: Column) -> Column:
    return F.length(strip(F.coalesce(x, F.lit("")))) == 0


def words(x: Column) -> Column:
    """Words between runs of white space; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), "")


def sentences(x: Column) -> Column:
    """Sentences end at . ! ? or an ideographic full stop with white space behind it."""
    return F.array_remove(F.transform(F.split(F.coalesce(x, F.lit("")), r"(?U)(?<=[.!?。])\s+"), strip), "")


def lines_clean(x: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.array_remove(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), strip), "")


def lines_kept(x: Column) -> Column:
    """Lines with their ends: line feeds, carriage returns with one or without, and the other line and paragraph breaks of Unicode. Together they are the text."""
    return F.split(x, r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)")


def normalise(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit("")))


def normalise_any(x: Column) -> Column:
    """A variant as stripped text: of an object its first field named content, text, answer or output, of a list its items that are not empty, one a line.

    Null is empty, as is a field that is null; numbers and other objects are as JSON spells them.
    """
    kind = lambda v, name: F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lit(name))
    fields = [F.try_variant_get(x, f"$.{name}", "variant") for name in ("content", "text", "answer", "output")]
    inner = F.when(kind(x, "OBJECT"), F.coalesce(*fields, x)).otherwise(x)

    def shown(v: Column) -> Column:
        items = F.filter(F.try_variant_get(v, "$", "array<string>"), lambda i: F.coalesce(i, F.lit("")) != "")
        return F.when(v.isNull() | kind(v, "VOID"), "").when(kind(v, "ARRAY"), F.array_join(items, "\n")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))

    return strip(F.coalesce(shown(inner), F.lit("")))


def natural_key(x: Column) -> Column:
    """Compares as people number things: runs of digits as numbers (up to 20 digits), the rest without case."""
    parts = F.regexp_extract_all(x, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p)))


def store_name(x: Column, prefix: str = "cleaned_", limit: int = 63) -> Column:
    """A name for a store: letters, digits, _ and - only, prefixed, at most ``limit`` long, no mark at its ends."""
    core = F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return F.btrim(F.substring(F.concat(F.lit(prefix), core), 1, limit), F.lit("_-."))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def group_of(name: Column) -> Column:
    """A stem without the page number at its end."""
    return F.regexp_replace(name, r"_\d+$", "")


def unfence(x: Column) -> Column:
    """The content of a text that begins with a code fence: without its first line, cut at the last fence."""
    body = F.regexp_replace(strip(x), r"^```[^\n]*\n?", "")
    return F.when(F.startswith(strip(x), F.lit("```")), strip(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))).otherwise(strip(x))


def bag(x: Column) -> Column:
    """Lower-case word characters for lexical indexes."""
    return F.array_remove(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


#: Tokenizers by name: functions from a text column to an array of words. A deployment adds its own, morphological ones as Arrow UDFs.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"bag": bag, "words": words}


def tokenizer(name: str) -> Callable[[Column], Column]:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer: {name}; there are {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name]
