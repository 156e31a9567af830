"""How the sources of a language differ in the words they use, by exact integer shares of the words that enough documents have.

Two passes over the texts. The first counts in how many documents of its language each term stands; terms in MIN_DOCS or more are kept. The
second counts their occurrences per (language, source) with Aho-Corasick automata over the kept terms, each with a blank on both sides,
run over texts whose terms are joined by single blanks: an occurrence is one match, and no part of a longer term is.

Workers hold the automata of one block of the vocabulary, BLOCK_CHARS characters at most; a larger vocabulary is counted in as many passes as
it has blocks, all terms in full. Both passes add up within a task before anything is shuffled; what a task holds is bounded by HELD entries, or by PLACES
occurrences, which are held as bare numbers.

Counts that are zero are not written. Sources are compared in tiles of TILE by TILE of them, from the postings of about TILE terms at a time: each term that
a source of the tile has adds once to its sums; all others add the difference of what the two sources give to terms they lack, one product.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.workers import no_cycles
from quern.workspace import materialize

MIN_DOCS, PRIOR, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
BLOCK_CHARS = 1 << 23  # some 500 MB of automata at most
HELD = 1 << 19
PLACES = 1 << 23
TILE = 256

#: Bytes of UTF-8: A-Z in lower case, and what stands between terms, which is all of ASCII but its letters, as blanks.
_PLAIN = bytes(b if b > 0x7F or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def padded_terms(text: str | None) -> bytes:
    """The text's terms with A-Z in lower case, each between two single blanks, in UTF-8."""
    return b" %s " % b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def _flush(counts: dict[str, Counter]) -> pa.RecordBatch:
    """A row per language and term."""
    of = pa.array(np.repeat(np.arange(len(counts)), [len(found) for found in counts.values()]))
    terms = pa.array([term for found in counts.values() for term in found], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()).take(of), terms, pa.array([n for found in counts.values() for n in found.values()], pa.int64())], names=["lang", "term", "n"])


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(lang, term, n_docs) of texts (lang, source, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0
        with no_cycles():
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = counts.setdefault(lang, Counter())
                    held -= len(found)
                    found.update(set(padded_terms(text.as_py()).split()))
                    held += len(found)
                    if held > HELD:
                        yield _flush(counts)
                        counts, held = {}, 0
            yield _flush(counts)

    found = texts.select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).withColumn("term", F.decode("term", "UTF-8"))


def vocabulary(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, id) of the terms that at least min_docs documents of the language have, written down; ids ascend with lang and term."""
    kept = document_frequencies(texts).where(F.col("n_docs") >= min_docs).select("lang", "term")
    return materialize(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()), "divergence-terms")


def _automata(terms: pd.DataFrame) -> dict[str, ahocorasick.Automaton]:
    """One per language, which give the places of terms in the table: automata hold integers of 32 bits, ids have more."""
    built = {}
    for lang, group in terms.reset_index(drop=True).groupby("lang"):
        built[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in group["term"].items():
            built[lang].add_word(f" {term} ", number)
        built[lang].make_automaton()
    return built


#: Automata of the block that this worker used last, by the number of its broadcast.
_BUILT: dict[int, dict] = {}


def _count_block(texts: DataFrame, terms: pd.DataFrame) -> DataFrame:
    """(lang, source, id, n) of the occurrences of one block of terms, as many rows as tasks found sums."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)
    number, second = sent._jbroadcast.id(), itemgetter(1)

    def counted(found: dict[tuple[str, str], array]) -> pa.RecordBatch:
        """A row per group and term from the places of its occurrences."""
        ids = sent.value["id"].to_numpy()
        kept, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for places in found.values():
            some, n = np.unique(np.frombuffer(places, dtype=np.int32), return_counts=True)
            kept.append(ids[some])
            sums.append(n)
        of = pa.array(np.repeat(np.arange(len(found)), [len(n) for n in sums[1:]]))
        groups = [pa.array([group[i] for group in found], pa.string()).take(of) for i in range(2)]
        return pa.RecordBatch.from_arrays([*groups, pa.array(np.concatenate(kept), pa.int64()), pa.array(np.concatenate(sums), pa.int64())], names=["lang", "source", "id", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = _automata(sent.value)
        automata = _BUILT[number]
        found: dict[tuple[str, str], array] = {}
        held = 0
        with no_cycles():
            for batch in batches:
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if lang not in automata:
                        continue
                    places = found.setdefault((lang, source), array("i"))
                    held -= len(places)
                    places.extend(map(second, automata[lang].iter(padded_terms(text.as_py()).decode("utf-8", "surrogatepass"))))
                    held += len(places)
                    if held > PLACES:
                        yield counted(found)
                        found, held = {}, 0
            yield counted(found)

    return texts.select("lang", "source", "text").mapInArrow(count, "lang string, source string, id long, n long")


def occurrences(texts: DataFrame, terms: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(lang, source, id, n) with n > 0 of the terms (lang, term, id, written down), written down."""
    chars = terms.agg(F.sum(F.length("term") + F.length("lang") + 2)).first()[0] or 0
    blocks = max(1, -(-chars * 5 // (4 * block_chars)))  # hashed blocks are not quite equal
    found = []
    for block in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)) == block).toPandas()
        found.append(materialize(_count_block(texts, some).groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "divergence-counts"))
    return reduce(DataFrame.unionByName, found)


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)) of columns, in decimals, which neither round nor overflow; null where kept is 0."""
    wide = "decimal(20, 0)"
    part = f"cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as {wide}) div cast({total} + {PRIOR} * {kept} as {wide})"
    return F.when(F.col(kept) > 0, F.expr(f"1 + {part}"))


def group_table(texts: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, sid, total, kept, lang_total, zero) of every group, written down.

    sid numbers the sources of a language from 0 by name, total adds up the kept terms of the group, kept counts those of the language, and zero is
    the share of a term that the group lacks.
    """
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    of_lang = W.partitionBy("lang")
    groups = groups.withColumn("sid", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long")).withColumn("lang_total", F.sum("total").over(of_lang))
    return materialize(groups.withColumn("none", F.lit(0)).withColumn("zero", share("none", "total", "kept")).drop("none"), "divergence-groups")


def _tile_sums(postings: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of some postings (sid, id, p) for all pairs of the tile's sources (v_sid, v_zero, v_side), both ways round."""
    sides, sids, zeros = (sources[c].to_numpy() for c in ("v_side", "v_sid", "v_zero"))
    order = np.lexsort((sids, sides))
    sides, sids, zeros = sides[order], sids[order], zeros[order]
    names = ["lang", "sid", "other", "part", "seen"]
    if not postings.num_rows or not len(sids):
        return pa.table([pa.array([], pa.string())] + [pa.array([], pa.int64())] * 4, names=names)
    row = np.unique(postings["id"].to_numpy(), return_inverse=True)[1]
    ranked = np.argsort(sids, kind="stable")
    column = ranked[np.searchsorted(sids[ranked], postings["sid"].to_numpy())]
    shares = np.repeat(zeros[None, :].astype(np.int64), row.max() + 1, axis=0)
    shares[row, column] = postings["p"].to_numpy()
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == sides.max())
    sums = np.array([np.abs(shares[:, right] - shares[:, [i]]).sum(axis=0) for i in left])
    first, second, value = np.repeat(sids[left], len(right)), np.tile(sids[right], len(left)), sums.ravel()
    if sides.max():  # two blocks of sources: the other way round as well
        first, second, value = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([value, value])
    apart = first != second
    n, lang = int(apart.sum()), postings["lang"][0].as_py()
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(first[apart]), pa.array(second[apart]), pa.array(value[apart]), pa.array(np.full(n, len(shares)), pa.int64())], names=names)


def pair_sums(counts: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of |p - q| over all its kept terms."""
    block = F.expr(f"sid div {tile}")
    known = groups.where("kept > 0").withColumn("block", block).withColumn("blocks", F.max("block").over(W.partitionBy("lang")) + 1)
    known = known.withColumn("salts", F.expr(f"(kept + {TILE} - 1) div {TILE}"))
    tiles = F.explode(F.expr("transform(sequence(0L, blocks - 1), o -> struct(least(block, o) as low, greatest(block, o) as high))"))
    dealt = known.withColumn("tile", tiles).select("lang", "source", "sid", "total", "kept", "zero", "salts", "tile.low", "tile.high", (F.col("block") > F.col("tile.low")).cast("int").alias("side"))
    postings = counts.join(dealt, ["lang", "source"]).withColumn("p", share("n", "total", "kept")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    postings = postings.select("lang", "low", "high", "salt", "sid", "id", "p")
    vectors = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    vectors = vectors.select(*[F.col(c).alias(f"v_{c}") for c in ("lang", "low", "high", "salt", "sid", "zero", "side")])
    key = ["lang", "low", "high", "salt"]
    parts = postings.groupBy(*key).cogroup(vectors.groupBy(*[f"v_{k}" for k in key])).applyInArrow(_tile_sums, "lang string, sid long, other long, part long, seen long")
    sums = parts.groupBy("lang", "sid", "other").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    ones, others = groups.select("lang", "source", "sid", "kept", "zero"), groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("other"), F.col("zero").alias("other_zero"))
    pairs = ones.join(others, "lang").where("sid <> other").join(sums, ["lang", "sid", "other"], "left")
    rest = (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.coalesce(F.abs(F.col("zero") - F.col("other_zero")), F.lit(0))
    return pairs.select("lang", "source", "item", (F.coalesce("part", F.lit(0)) + rest).alias("value"))


def term_gains(counts: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, id, value, rank): terms of a group with a larger share there than in the language, and by how much, the first ``ranks`` of them."""
    overall = counts.groupBy("lang", "id").agg(F.sum("n").alias("lang_n"))
    known = counts.join(groups, ["lang", "source"]).join(overall, ["lang", "id"])
    gains = known.withColumn("value", share("n", "total", "kept") - share("lang_n", "lang_total", "kept")).where("value > 0")
    best = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))
    return gains.select("lang", "source", "id", "value").withColumn("rank", best).where(F.col("rank") <= ranks)


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block_chars: int = BLOCK_CHARS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of docs.

    Part "pair": each other source of the language, farthest first. Part "term": the term_ranks terms whose share in the group exceeds that in the
    language most. Ties go to the smaller item, bytewise. Null languages, sources and texts count as empty; groups without a kept term have pairs and no
    terms; where a language keeps none all values are 0. Rows count as often as they are there, and other columns are not read. An
    empty table has no rows. Texts of any length are read whole, one at a time.
    """
    empty = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    terms = vocabulary(texts, min_docs)
    counts = occurrences(texts, terms, block_chars)
    groups = group_table(texts, terms, counts)
    farthest = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(counts, groups, tile).withColumn("rank", farthest).withColumn("part", F.lit("pair"))
    gains = term_gains(counts, groups, term_ranks).join(terms.select("id", F.col("term").alias("item")), "id").withColumn("part", F.lit("term"))
    return pairs.unionByName(gains.drop("id")).select("lang", "source", "part", "item", "value", "rank")
