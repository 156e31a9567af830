"""Quality rules with thresholds that adapt to language and source. DataFrame functions only.

Every document gets integer measures. Of documents that pass the base rules, the values above zero are summed up per language and source in
log-linear histograms: a value keeps its leading six bits, so that a bucket is at most 1/32 of its values wide, and sketches merge
by adding counts, exactly and in any order. Documents are held against fences by their buckets, so that where all are alike none is beyond. No measure has a cutoff of its own: a group's fence is the third quartile of its sketch
plus ``spread`` interquartile ranges, so that it lies where that group's usual values end. Fences are shrunk towards that of the merged sketch
of the language as if this were ``prior`` further documents, and those of languages towards that of all documents; a group without values has its language's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.workspace import materialize

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[\p{P}\p{S}]"
#: How many interquartile ranges a fence lies above the third quartile: what fit_spreads() gives for labelled documents of sf0.1 with odd ids (those with even ids are held out).
SPREADS = {"marks": 4, "word_length": 6}
PRIOR = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
GROUP_COLUMNS = ("lang", "source")


def base_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_text (long) of every row; a null text has no words.

    n_marks counts punctuation and symbols, n_text the characters of the text.

    n_repeat_words: 64-bit hashes of the three-word windows, their lowest bits replaced by the window's place, are
    sorted; neighbours with equal hashes are windows that occur again, which their words confirm. Repeated windows cover
    three words each, less what the next one covers too.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = rows.select(*keep, "__t", F.btrim("__t", F.lit(WHITE_CHARS)).alias("__b"))
    split = F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", WHITE))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    rows = rows.select(*keep, split.alias("__w"), lines.alias("__l"), F.when(F.col("__t").rlike(SYMBOLS), F.regexp_count("__t", F.lit(SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"), F.regexp_count("__t", F.lit(MARKS)).cast("long").alias("n_marks"), F.length("__t").cast("long").alias("n_text"))
    rows = rows.select(
        *keep, "__w", "n_symbols", "n_marks", "n_text", F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.length(F.bin(F.size("__w"))).alias("__s"),
    )
    packed = F.expr("""
        IF(n_words < 3, CAST(array() AS array<bigint>), sort_array(transform(sequence(0, size(__w) - 3),
            i -> shiftleft(shiftright(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)), __s), __s) | CAST(i AS bigint))))""")
    rows = rows.select(*keep, "__w", "__s", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks", "n_text", packed.alias("__p"), F.expr("shiftleft(1L, __s) - 1").alias("__m"))
    again = F.expr("""
        sort_array(transform(filter(__p, (v, k) ->
            (shiftright(v, __s) = shiftright(get(__p, k - 1), __s) AND slice(__w, CAST(v & __m AS int) + 1, 3) = slice(__w, CAST(get(__p, k - 1) & __m AS int) + 1, 3))
            OR (shiftright(v, __s) = shiftright(get(__p, k + 1), __s) AND slice(__w, CAST(v & __m AS int) + 1, 3) = slice(__w, CAST(get(__p, k + 1) & __m AS int) + 1, 3))),
            v -> v & __m))""")
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks", "n_text", again.alias("__r"))
    covered = F.expr("aggregate(transform(__r, (p, k) -> least(3L, coalesce(get(__r, k + 1) - p, 3L))), 0L, (a, x) -> a + x)")
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks", "n_text", covered.alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    """Integer measures from the columns of base_counts(): marks in a thousand characters, and hundredths of characters a word.

    Repeated words and lines have no fence: what the base rule leaves of them no group's fence turned down.
    """
    share = lambda times, part, whole: F.expr(f"({times} * {part}) div greatest({whole}, 1L)")
    return {"marks": share(1000, "n_marks", "n_text"), "word_length": share(100, "word_chars", "n_words")}


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def bucket(value: Column) -> Column:
    """The value with all but its leading six bits cleared: the lower end of its bucket."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per language, source and measure. Null keys count as empty ones."""
    listed = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in measures().items()))).alias("m")
    rows = counted.where(~base_failed()).select(*_keys(), listed).where("m.value > 0")
    return rows.groupBy(*GROUP_COLUMNS, "m.measure", bucket(F.col("m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _keys() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in GROUP_COLUMNS]


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], spreads: dict[str, int], name: str) -> DataFrame:
    """(keys, measure, <name>_n, <name>_fence): from the quartiles of each sketch, whose rows are as few as its buckets."""
    group = W.partitionBy(*keys, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    found = ranked.groupBy(*keys, "measure").agg(F.max("total").alias(f"{name}_n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = F.coalesce(*(F.when(F.col("measure") == measure, F.lit(value)) for measure, value in spreads.items()))
    return found.select(*keys, "measure", f"{name}_n", (F.col("q3") + spread * (F.col("q3") - F.col("q1"))).alias(f"{name}_fence"))


def thresholds(counted: DataFrame, spreads: dict[str, int] = SPREADS, prior: int = PRIOR) -> DataFrame:
    """(lang, source, fence_<measure>...): the fences that hold for each language and source. A measure that is zero everywhere has none.

    counted is read several times: a written table of base_counts().
    """
    own = materialize(sketches(counted), "quality-sketch")
    groups = counted.select(*_keys()).distinct().select("*", F.explode(F.array(*map(F.lit, spreads))).alias("measure"))
    joined = groups.join(fences(own, list(GROUP_COLUMNS), spreads, "own"), [*GROUP_COLUMNS, "measure"], "left")
    joined = joined.join(fences(merge(own, ["lang"]), ["lang"], spreads, "lang"), ["lang", "measure"], "left").join(fences(merge(own, []), [], spreads, "all"), "measure", "left")
    shrunk = lambda name, upper: f"coalesce(({name}_n * {name}_fence + {prior} * ({upper})) div ({name}_n + {prior}), {upper})"
    joined = joined.withColumn("chosen", F.expr(shrunk("own", shrunk("lang", "all_fence"))))
    return joined.groupBy(*GROUP_COLUMNS).agg(*(F.max(F.when(F.col("measure") == name, F.col("chosen"))).alias(f"fence_{name}") for name in spreads))


def fit_spreads(docs: DataFrame, labels: DataFrame, most: int = 64) -> dict[str, int]:
    """For each measure the smallest whole spread whose fences turn down no document of labels (doc_id, quality) with quality 1 that passes the base rule."""
    counted = materialize(base_counts(docs), "quality-counts")
    good = counted.where(~base_failed()).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    good = materialize(good.withColumns({c: F.coalesce(c, F.lit("")) for c in GROUP_COLUMNS}), "quality-good")
    found: dict[str, int] = {}
    for spread in range(most + 1):
        open_ = [name for name in measures() if name not in found]
        if not open_:
            break
        bounds = good.join(thresholds(counted, {name: spread for name in open_}), list(GROUP_COLUMNS), "left")
        beyond = bounds.agg(*(F.count_if(bucket(measures()[name]) > F.col(f"fence_{name}")).alias(name) for name in open_)).first()
        found |= {name: spread for name in open_ if not beyond[name]}
    return found


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), spreads: dict[str, int] = SPREADS, prior: int = PRIOR) -> DataFrame:
    """keep, the counts of base_counts(), base_failed, failed (names of measures beyond their fences) and kept, for every row of docs.

    keep must hold lang and source; null ones are groups of their own. Repeated rows are judged one by one; an empty table gives no rows; texts of
    any length are measured whole.
    """
    counted = materialize(base_counts(docs, keep=keep), "quality-counts")
    # Written down, the thresholds have a known size: small ones are broadcast, and a hot source is not dealt to one task.
    bounds = materialize(thresholds(counted, spreads, prior), "quality-bounds").select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(f"fence_{name}" for name in spreads))
    same = (F.coalesce("lang", F.lit("")) == F.col("__lang")) & (F.coalesce("source", F.lit("")) == F.col("__source"))
    joined = counted.join(bounds, same, "left")
    beyond = F.array_compact(F.array(*(F.when(bucket(value) > F.col(f"fence_{name}"), F.lit(name)) for name, value in measures().items())))
    result = joined.withColumn("base_failed", base_failed()).withColumn("failed", beyond)
    return result.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("__lang", "__source", *(f"fence_{name}" for name in spreads))


def keep_good(docs: DataFrame, spreads: dict[str, int] = SPREADS, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that pass, with all their columns. Verdicts are found by doc_id; rows that share one stay only if all of them pass."""
    verdicts = judged(docs, spreads=spreads, prior=prior)
    rejected = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__rejected")).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("__rejected")), "left_anti")
