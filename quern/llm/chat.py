"""Multi-party perspective rotation of dialogues. DataFrame functions only.

Every participant of a conversation gets a rendering of it in which that speaker is the assistant, all others are
named users, and system messages stay what they are. The mask lists the character ranges (in code points, end exclusive) that a model
speaking as the assistant is trained on: the assistant's words and the end mark after them.

Turns stand in order of turn, then speaker and text; a null turn comes first, a null text is empty, and a null or blank speaker is
called ``unknown``. Repeated turns are rendered as often as they stand. A null conversation id is a conversation of its own; an empty table gives no rows;
columns of other names do not matter. Conversations with none but system messages have no participants and no rows.
Marks inside texts and names are broken up by a space, so that no text can end its own message.

A dialogue is one row per speaker up to ``part_turns`` messages. Of a longer one each row holds so many messages (``part`` counts them from 0), so that no
task needs all of it: its parts, joined in order, are the rendering of the whole dialogue, and mask ranges are places in the whole. Messages are
counted in their order, whatever their turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.records import running_sums
from quern.workspace import materialize

BEGIN, END = "<|begin|>", "<|end|>"
SYSTEM = "system"
PART_TURNS = 1024
BLOCK = 64


def _safe(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def _in_parts(rows: DataFrame, part_turns: int) -> tuple[DataFrame, bool]:
    """rows (conv_id, m) with their part, and whether any dialogue has more than one. Only long dialogues are numbered."""
    long = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_turns).select(F.col("conv_id").alias("__conv"))
    long = materialize(long, "chat-long")
    if long.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")), False
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    numbered = running_sums(rows.join(long, same, "left_semi").withColumn("__one", F.lit(1)), ["conv_id", "m"], "__one", "__at")
    firsts = materialize(numbered.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("__at").alias("__first")), "chat-firsts")
    parted = numbered.join(firsts, same).select("conv_id", "m", F.expr(f"(__at - __first) div {part_turns}").alias("part"))
    return rows.join(long, same, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(parted), True


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, rendered, mask array<struct<start,end>>, n_turns, n_own)."""
    blank = F.btrim(F.coalesce(F.col(speaker_col).cast("string"), F.lit("")))
    speaker = F.when(blank == "", F.lit("unknown")).otherwise(F.regexp_replace(_safe(blank), r"\s+", " "))
    text = _safe(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), text.alias("text")).alias("m"))
    # Written down, so that a hot conversation's parts are not dealt to one task when they meet its speakers.
    speakers = materialize(rows.where(F.col("m.speaker") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("m.speaker").alias("speaker")).distinct(), "chat-speakers")
    parted, cut = _in_parts(rows, part_turns)
    parts = parted.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    each = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    head = f"IF(m.speaker = speaker, '{BEGIN}assistant\\n', IF(m.speaker = '{SYSTEM}', '{BEGIN}system\\n', concat('{BEGIN}user name=', m.speaker, '\\n')))"
    pieces = f"transform(messages, m -> named_struct('own', m.speaker = speaker, 'head', {head}, 'body', concat(m.text, '{END}')))"
    keys = ["conv_id", "speaker", "part"]
    each = each.select(*keys, F.expr(pieces).alias("pieces"))
    each = each.select(*keys, "pieces", F.expr("transform(pieces, p -> CAST(length(p.head) + length(p.body) + 1 AS bigint))").alias("sizes"))
    each = each.select(*keys, "pieces", "sizes", F.expr(f"transform(sequence(0, size(sizes) div {BLOCK}), b -> aggregate(slice(sizes, CAST(b * {BLOCK} + 1 AS int), {BLOCK}), 0L, (a, x) -> a + x))").alias("blocks"))
    before = F.lit(0).cast("long")
    if cut:
        each = materialize(each, "chat-parts")
        earlier = W.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one number per part
        lengths = each.select(*keys, F.expr("aggregate(blocks, 0L, (a, x) -> a + x)").alias("size")).withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        lengths = materialize(lengths.select(*(F.col(k).alias(f"__{k}") for k in keys), "__before"), "chat-lengths")
        each = each.join(lengths, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("speaker") == F.col("__speaker")) & (F.col("part") == F.col("__part")))
        before = F.col("__before")
    start = f"__from + aggregate(slice(blocks, 1, i div {BLOCK}), 0L, (a, x) -> a + x) + aggregate(slice(sizes, CAST(i div {BLOCK} * {BLOCK} + 1 AS int), i % {BLOCK}), 0L, (a, x) -> a + x)".replace(f"i div {BLOCK})", f"CAST(i div {BLOCK} AS int))")
    ranges = f"transform(filter(transform(pieces, (p, i) -> named_struct('own', p.own, 'start', IF(p.own, {start} + length(p.head), 0L), 'size', CAST(length(p.body) AS bigint))), r -> r.own), r -> named_struct('start', r.start, 'end', r.start + r.size))"
    rendered = "array_join(transform(pieces, p -> concat(p.head, p.body, '\\n')), '')"
    each = each.withColumn("__from", before)
    return each.select(*keys, F.expr(rendered).alias("rendered"), F.expr(ranges).alias("mask"), F.size("pieces").cast("long").alias("n_turns"), F.expr("CAST(size(filter(pieces, p -> p.own)) AS bigint)").alias("n_own"))
