"""op13 against counting by hand: edges, several blocks of the vocabulary, several tiles of sources."""

import random
import re
from collections import Counter

import pytest
from quern.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, kept string, sid string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=30, ranks=50):
    rows = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in mine for t in set(r[2]))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: Counter(t for r in mine if r[1] == s for t in r[2] if docs[t] >= min_docs) for s in {r[1] for r in mine}}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for source, own in counts.items():
            pairs = [(other, sum(abs(share(own, t) - share(c, t)) for t in kept)) for other, c in counts.items() if other != source]
            gains = [(t, share(own, t) - share(whole, t)) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", gains, ranks)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def texts(seed):
    """Nulls in every column, texts without terms, long texts, groups without kept terms, a language that keeps none, terms inside others."""
    draw = random.Random(seed)
    words = ["a", "ab", "abc", "b", "Ünder", "ünder", "x\x85y", "日本", "naïve", "i", "İ", "ß", *(f"w{c}{d}" for c in "abcdefgh" for d in "klmnop")]
    rows = []
    for i in range(700):
        lang = draw.choice(["en", "en", "en", None, "", "fr"])
        source = draw.choice(["s0", "s0", "s0", None, "", *(f"s{j}" for j in range(1, 9)), "é"])
        some = draw.choices(words[: draw.choice([5, 20, 60])], k=draw.choice([0, 1, 5, 40]))
        rows.append((i, draw.choice([" ", ", ", "1", "\n", "_"]).join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in some), lang, source))
    rows += [(None, None, "en", "none"), (1, None, None, None), (2, "", "de", "only"), (2, "Wort", "de", "zwei"), (2, "Wort", "de", "zwei"), (3, "ab " * 200000, "en", "long")]
    draw.shuffle(rows)
    return rows


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "t", 0, "k", "s") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in divergence.audit_sources(docs, **more).collect())


@pytest.mark.parametrize("more", [{}, {"block_chars": 40}, {"tile": 3}, {"min_docs": 1, "term_ranks": 3}])
def test_audit(spark, more):
    rows = texts(1)
    assert found(spark, rows, **more) == brute(rows, more.get("min_docs", 30), more.get("term_ranks", 50))


def test_tasks_that_hold_little(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = texts(2)
    assert found(spark, rows) == brute(rows)


def test_tasks_that_hold_few_occurrences(spark, monkeypatch):
    """Places are given out as counts again and again, within a group and between groups."""
    monkeypatch.setattr(divergence, "PLACES", 50)
    rows = texts(4)
    assert found(spark, rows) == brute(rows)


def test_terms_numbered_in_several_partitions(spark):
    """Ids of more than 32 bits, as large vocabularies have them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = texts(3)
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "", None, None)]) == []


def test_terms():
    assert divergence.padded_terms(None) == b"  " and divergence.padded_terms("1 2_3") == b"  "
    assert divergence.padded_terms("It's AÉ\x85b\x00c") == " it s aÉ\x85b c ".encode()
    everything = "".join(f"{c}q{c}{c}Z" for c in map(chr, [*range(0x180), 0x2003, 0x3042, 0xFFFF, 0x1F600]))
    assert divergence.padded_terms(everything).decode().split(" ")[1:-1] == TERM.findall(lower(everything))
