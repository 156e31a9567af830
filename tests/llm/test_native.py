import hashlib
import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F
from quern.llm import chat, decontaminate, pii, quality, queries_pii
from quern.llm.pii_train import TextMaker, labelled
from quern.workspace import materialize

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = [w for w in WHITE.split(text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WHITE.sub("", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def texts(seed=1):
    pick = random.Random(seed)
    made = ["".join(pick.choice(["a", "b", "é ", " ", "\n", "#", "|", "x y ", "\t"]) for _ in range(pick.randint(0, 400))) for _ in range(150)]
    return made + [None, "", " \n\t", "one", "one two", "a b c a b c", "same line\nsame line\n \n \nsame line \n", "w " * 20000, " ".join(f"w{i}" for i in range(20000)), "🎉 $$ <b> " * 30]


def test_base_counts_match_brute_force(spark):
    rows = [(i, t, "en", None if i % 5 else "s", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judged(docs).collect()}
    assert got == {i: brute_counts(t) for i, t, *_ in rows}


def brute_bucket(v):
    shift = max(0, max(1, v.bit_length()) - 6)
    return v >> shift << shift


def brute_measures(text):
    n, chars, _, _, repeats = brute_counts(text)
    marks = sum(unicodedata.category(c)[0] in "PS" for c in text or "")
    passed = n >= 50 and 100 * repeats <= 50 * n
    return passed, {"marks": 1000 * marks // max(len(text or ""), 1), "word_length": 100 * chars // max(n, 1)}


def brute_fences(rows):
    """{(lang, source): {measure: fence}} of rows (id, text, lang, source)."""
    measured, groups = [(lang or "", source or "", *brute_measures(t)) for _, t, lang, source in rows], {}
    for lang, source, passed, values in measured:
        for key in ((lang, source), (lang,), ()) if passed else ():
            for name, value in values.items():
                if value:
                    groups.setdefault((key, name), []).append(brute_bucket(value))

    def fence(key, name, upper):
        values = sorted(groups.get((key, name), []))
        if not values:
            return upper
        q1, q3 = (next(v for j, v in enumerate(values, 1) if 4 * j >= k * len(values)) for k in (1, 3))
        own = q3 + quality.SPREADS[name] * (q3 - q1)
        return own if upper is None else (len(values) * own + quality.PRIOR * upper) // (len(values) + quality.PRIOR)

    return {(lang, source): {m: fence((lang, source), m, fence((lang,), m, fence((), m, None))) for m in quality.SPREADS} for lang, source, *_ in measured}


def brute_kept(rows):
    """Ids of the rows (id, text, lang, source) that pass."""
    fences = brute_fences(rows)
    beyond = lambda values, bounds: any(bounds[m] is not None and brute_bucket(values[m]) > bounds[m] for m in values)
    verdicts = ((i, *brute_measures(t), fences[lang or "", source or ""]) for i, t, lang, source in rows)
    return {i for i, passed, values, bounds in verdicts if passed and not beyond(values, bounds)}


def quality_rows():
    pick, rows = random.Random(2), []
    for i in range(700):
        lang, n = pick.choice(["en", "en", None]), pick.randint(30, 120)
        mark = "," * (1 + (lang is None))
        text = " ".join(pick.choice(["alpha", "beta", "gamma", "delta"]) + "xyz" * (lang is None) + str(pick.randint(0, 40)) + mark * (pick.random() < 0.02 * (i % 40)) for _ in range(n))
        text = "!#" * 60 + text if i % 31 == 0 else text + "\nsame\nsame" * (i % 7 == 0)
        rows.append((i, text, lang, pick.choice(["big", "big", "big", "small", None]) if i % 50 else "tiny"))
    return rows


def test_verdicts_match_brute_force(spark):
    rows = quality_rows()
    want = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality.judged(docs).collect() if r["kept"]} == want
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == want and 0 < len(want) < len(rows)


def test_fences_differ_by_group(spark):
    docs = spark.createDataFrame(quality_rows(), "doc_id long, text string, lang string, source string")
    found = {(r["lang"], r["source"]): r for r in quality.thresholds(materialize(quality.base_counts(docs), "counts")).collect()}
    want = brute_fences(quality_rows())
    assert {k: {m: r[f"fence_{m}"] for m in quality.SPREADS} for k, r in found.items()} == want
    assert all(len({bounds[m] for bounds in want.values()}) > 1 for m in ("marks", "word_length"))


def test_labelled_documents(spark):
    """Documents with even ids: the spreads were chosen on those with odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 2 = 0")
    counts = {r["quality"]: (r["n"], r["kept"]) for r in quality.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert counts[0][1] == 0 < counts[0][0] and counts[1][1] >= 0.98 * counts[1][0]
    failed = Counter(name for r in quality.judged(docs).where("not base_failed").collect() for name in r["failed"])
    assert set(failed) == set(quality.SPREADS) and min(failed.values()) >= 5  # every measure turns down what the base rule leaves
    bounds = quality.thresholds(materialize(quality.base_counts(docs), "counts")).collect()
    assert len(bounds) == 80 and all(len({r[f"fence_{m}"] for r in bounds}) >= 8 for m in quality.SPREADS)


def test_spreads_are_fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    assert quality.fit_spreads(docs, labels.where("doc_id % 2 = 1")) == quality.SPREADS


def test_documents_that_are_all_alike_stay(spark):
    """A source of copies has no spread; its usual value is not beyond its own fence."""
    text = " ".join(f"word{i}, so" for i in range(60))
    docs = spark.createDataFrame([(i, text, "en", "copies") for i in range(300)] + [(900, "!" * 500 + text, "en", "copies")], "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == list(range(300))


def test_empty_quality(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judged(docs).collect() == [] and quality.keep_good(docs).collect() == []


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_overlaps(docs, items):
    """Every item laid beside every text at every place: where as many words of a stretch agree as the share asks for, those that stand there or SLIP beside count."""
    span, slip, share = decontaminate.SPAN, decontaminate.SLIP, decontaminate.share_of
    classes, out, spots = {}, {}, {}
    for i, t in items:
        if tokens(t):
            classes.setdefault(tuple(tokens(t)), []).append(i)
    for item in classes:
        for k, word in enumerate(item):
            spots.setdefault(word, []).append((item, k))
    for doc, text in docs:
        agree = {}  # {item: {place: words of the item that stand where the place puts them}}
        for p, word in enumerate(tokens(text)):
            for item, k in spots.get(word, ()):
                agree.setdefault(item, {}).setdefault(p - k, set()).add(k)
        for item, places in agree.items():
            n, need = len(item), share(min(len(item), span))
            for d, there in places.items():
                if any(len(there & set(range(k, k + span))) >= need for k in there):
                    c = len(set().union(*(places.get(d + j, set()) for j in range(-slip, slip + 1))))
                    if c >= decontaminate.MIN_SHARE * n:
                        key = doc, min(classes[item]), n
                        out[key] = max(c, out.get(key, 0))
    return {(*key, c) for key, c in out.items()}


def test_overlaps_match_brute_force(spark):
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(n))) for i, n in enumerate((5, 11, 12, 13, 30, 30, 40))] + [(90, None), (91, ""), (92, " ... ")]
    items += [(50, items[4][1].upper() + "!")]
    docs = []
    for i in range(60):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 120))]
        if i % 2:
            passage = items[pick.randrange(7)][1].split()
            for _ in range(pick.randint(0, len(passage) // 6)):
                passage[pick.randrange(len(passage))] = "changed"
            at = pick.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, pick.choice([" ", ", ", "\n"]).join(words)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[5][1].title())]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_covered"]) for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 20
    dirty = {g[0] for g in got}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench).collect()} == {d for d, _ in docs} - dirty


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(20, 50)))], "item_id long, text string")
    want = decontaminate.overlaps(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    assert decontaminate.overlaps(docs, bench).collect() == want != []
    words, items = [f"w{i % 40}" for i in range(200)], [(1, "w3 w4 w5"), (2, "w7 x w9 w10"), (3, "w3 w4 w5"), (4, " ".join(f"w{i}" for i in range(5, 25)))]
    many = spark.createDataFrame([(i, " ".join(words[i : i + 50])) for i in range(100)] + [(5, "w3 w4"), (None, "w3 w4 w5")], "doc_id long, text string")
    few = spark.createDataFrame(items, "item_id long, text string")
    large = sorted(map(str, decontaminate.overlaps(many, few).collect()))
    monkeypatch.undo()
    assert large == sorted(map(str, decontaminate.overlaps(many, few).collect())) and len(large) > 50
    assert sorted(map(tuple, decontaminate.item_members(few).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4)]


@pytest.mark.parametrize("share", [0.6, 0.8])
def test_masks_miss_nothing(share):
    """All ways to keep a share of up to fourteen words: some mask finds words that were kept. Longer items: see the module."""
    for n in range(1, 15):
        masks = decontaminate.masks_for(n, share)
        for kept in combinations(range(n), decontaminate.share_of(n, share)):
            there = set(kept)
            assert any(at + mask[-1] < n and all(at + k in there for k in mask) for at in range(n) for mask in masks)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 20, 25, 40, 60])
def test_substitutions_are_found(spark, n):
    """Words replaced at random up to what the share allows, at the ends as well: all of these documents hold the item."""
    pick, item = random.Random(n), [f"w{i}" for i in range(n)]
    most = n - decontaminate.share_of(n)
    texts = []
    for i in range(60):
        gone = {0, n - 1} if i < 10 and most > 1 else {i % n} if i < 30 and most else set(pick.sample(range(n), pick.randint(0, most)))
        texts.append((i, len(gone), " ".join(["x", *(f"o{k}" if k in gone else w for k, w in enumerate(item)), "y"])))
    docs = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, text string")
    found = {r["doc_id"]: r["n_covered"] for r in decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {i: n - gone for i, gone, _ in texts}


def test_words_put_in_and_left_out(spark):
    item = [f"w{i}" for i in range(20)]
    texts = [item[:9] + ["new"] + item[9:], item[:9] + item[10:], item[:6] + ["new", "new"] + item[6:14] + ["more"] + item[14:], item[:12], item[:11]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["n_covered"] for r in found} == {0: 20, 1: 19, 2: 20, 3: 12}


def test_rows_without_ids_and_repeated_rows(spark):
    """Rows without an id are one document, each looked at by its own text; columns that clash with the operator's own are left alone."""
    rows = [(None, "a b c d e f g", 1, "k"), (None, "g f e d c b a", 2, "k"), (None, None, 3, "k"), (4, "a b c d e f g", 4, "k"), (4, "a b c d e f g", 4, "k"), (4, "other", 5, "k"), (5, "other", 6, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int, key string")
    bench = spark.createDataFrame([(1, "A, b c d; e f g!", 0), (2, "a b c d e f g", 0), (3, None, 0)], "item_id long, text string, n_item int")
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()), key=str) == [(4, 1, 7, 7), (None, 1, 7, 7)]
    assert [tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()] == [(5, "other", 6, "k")]


def test_no_benchmark(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.overlaps(empty, bench).collect() == [] and decontaminate.overlaps(docs, bench.where("false")).collect() == []


TURNS = "conv_id long, turn long, role string, text string, speaker string"


def rotated(spark, rows, **options):
    return {(r["conv_id"], r["part"], r["speaker"]): r for r in chat.rotate_perspectives(spark.createDataFrame([(*r, "x") for r in rows], TURNS), **options).collect()}


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hé <|end|> 🎉"), (1, 2, "bob", None), (1, 3, "ann", "again"), (1, 3, "ann", "again"), (2, None, " ", "who"), (3, 0, "system", "alone"), (None, 0, "ann", "no id")]
    out = rotated(spark, rows)
    assert set(out) == {(1, 0, "ann"), (1, 0, "bob"), (2, 0, "unknown"), (None, 0, "ann")}
    ann = out[(1, 0, "ann")]
    assert ann["rendered"] == "<|begin|>system\nrules<|end|>\n<|begin|>assistant\nhé < |end|> 🎉<|end|>\n<|begin|>user name=bob\n<|end|>\n<|begin|>assistant\nagain<|end|>\n<|begin|>assistant\nagain<|end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hé < |end|> 🎉<|end|>", "again<|end|>", "again<|end|>"]
    bob = out[(1, 0, "bob")]
    assert [bob["rendered"][m["start"] : m["end"]] for m in bob["mask"]] == ["<|end|>"] and (bob["n_turns"], bob["n_own"]) == (5, 1)


def brute_perspectives(rows):
    """{(conv_id, speaker): (rendering, mask)} of rows (conv_id, turn, role, text)."""
    dialogues = {}
    for conv, turn, role, text in rows:
        role = " ".join((role or "").strip(" ").replace("<|", "< |").split()) or "unknown"
        dialogues.setdefault(conv, []).append((turn is not None, turn or 0, role, (text or "").replace("<|", "< |")))
    out = {}
    for conv, messages in dialogues.items():
        for speaker in {m[2] for m in messages} - {"system"}:
            rendered, mask = "", []
            for _, _, who, text in sorted(messages):
                rendered += chat.BEGIN + ("assistant" if who == speaker else "system" if who == "system" else f"user name={who}") + "\n"
                mask += [(len(rendered), len(rendered) + len(text + chat.END))] * (who == speaker)
                rendered += text + chat.END + "\n"
            out[conv, speaker] = rendered, mask
    return out


@pytest.mark.parametrize("part_turns", [7, 64, 1024])
def test_perspectives_match_brute_force(spark, part_turns):
    pick = random.Random(part_turns)
    rows = [(1, 5000 + i // 2 if i % 9 else None, pick.choice(["ann", "bob", " ", "system", "c  d"]), pick.choice(["hé 🎉", None, "<|end|>", "x" * 50])) for i in range(300)]
    rows += [(None, i, "ab"[i % 2], str(i)) for i in range(70)] + [(2, 1, "ann", "same")] * 66 + [(3, 0, "late", "x" * 2_000_000)] + [(4, None, None, None)] * 2
    got = {}
    for r in sorted(rotated(spark, rows, part_turns=part_turns).values(), key=lambda r: r["part"]):
        before = got.setdefault((r["conv_id"], r["speaker"]), ["", []])
        before[0] += r["rendered"]
        before[1] += [tuple(m) for m in r["mask"]]
        assert r["n_turns"] <= part_turns and r["n_own"] == len(r["mask"])
    assert {k: tuple(v) for k, v in got.items()} == brute_perspectives(rows)


def test_perspectives_of_nothing(spark):
    assert rotated(spark, []) == {}
    clash = spark.createDataFrame([(1, 0, "ann", "hi", 5, "r")], "conv_id long, turn long, role string, text string, part int, rendered string")
    assert chat.rotate_perspectives(clash).first()["rendered"] == "<|begin|>assistant\nhi<|end|>\n"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute_base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def pii_texts():
    pick = random.Random(9)
    fixed = [None, "", "a@b.c_d@e.f a@b@c.d x@y..z .@.a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 00000255.0.0.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 5 -7 12--34", "+1 (743) 555-3824 ++1 2 +123456789012345678 +1.", "é🎉 a@b.de ü +49 30 1234567 🎉 10.0.0.1", "1" * 3000, "a" * 3000 + "@", "1.2.3.4 " * 200, "x@y.z " * 100]
    return fixed + ["".join(pick.choice("01234567 .-+()@ab_é4\n") for _ in range(120)) for _ in range(600)] + [TextMaker(i).text()[0] for i in range(50)]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(pii_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for r in pii.detect(docs).collect():
        text = rows[r["doc_id"]][1]
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == brute_base(text)
        assert all(s["kind"] in pii.EXTRA and 0 <= s["start"] < s["end"] <= len(text) for s in r["added"])
        assert not any(b["start"] <= a["start"] and a["end"] <= b["end"] for a in r["added"] for b in r["base"])
    assert pii.detect(docs.where("false")).collect() == []


def account_holds(match):
    plain = re.sub("[^A-Z0-9]", "", match)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def brute_features(match, before, kind):
    digits, letters = re.findall("[0-9]", match), re.findall("[A-Za-z]", match)
    groups = re.findall("[0-9]+", match)
    cue = lambda words, tail: int(bool(re.search(f"(?i)({words}){tail}$", before)))
    return {
        "length": len(match), "digits": len(digits), "upper": sum(c.isupper() for c in letters), "lower": sum(c.islower() for c in letters), "hex_share": 100 * len(re.findall("[0-9a-fA-F]", match)) // len(match),
        "separators": len(match) - len(digits) - len(letters), "distinct": len(set(match)), "changes": len(groups), "bracket": int("(" in match or "[" in match),
        "secret_cue": cue("token|secret|passw|pwd|api|key|auth|bearer|credential", "[^\\n]{0,12}"), "number_cue": cue("tel|phone|call|mobile|fax|contact|ssn|social|dial|reach", "[^\\n]{0,14}"),
        "opened": int(bool(re.search("[=:\"'] ?$", before))), "other_cue": cue("order|invoice|isbn|item|ref|page|year|version|serial|lot|part|id|no[.:]?|nr[.:]?|#", "[^A-Za-z0-9\\n]{0,4}"),
        "first_group": len(groups[0]) if groups else 0, "second_group": len(groups[1]) if len(groups) > 1 else 0, "last_group": len(groups[-1]) if groups else 0,
        "zero_first": int(match[0] == "0" or not match[0].isdecimal() and match[1:2] == "0"), "dots": match.count("."), "hyphens": match.count("-"), "stop_inside": int(". " in match), "last_label": len(re.search("[A-Za-z]*$", match)[0]), "at_sign": int("@" in match),
        "spelled": int(bool(re.search(" (at|AT) ", match))) + int(bool(re.search(" (dot|DOT) ", match))), "checksum": int(kind == "account" and account_holds(match)), "account_cue": cue("iban|account|acct|konto|bank|transfer", "[^\\n]{0,14}"),
        "hash_cue": cue("commit|sha|md5|hash|digest|checksum|revision|blob|tree|etag", "[^A-Za-z\\n]{0,8}"), "slashes": match.count("/"), "words": len(re.findall("[a-z]{3,}", match)),
    }


def brute_added(text):
    text, out = text or "", []
    base = brute_base(text)
    for kind in pii.EXTRA:
        end = 0
        for m in regex.finditer(pii.PATTERNS[kind][0], text):
            found, end = brute_features(m[0], text[end : m.start()][-24:], kind), m.end()

            def leaf(node, found=found):
                while not isinstance(node, int):
                    node = node[2] if found[node[0]] <= node[1] else node[3]
                return node

            if not any(a <= m.start() and m.end() <= b for _, a, b in base) and sum(map(leaf, pii.TREES[kind])) > pii.THRESHOLDS[kind]:
                out.append((kind, m.start(), m.end()))
    return out


class OtherTexts:
    """Texts with personal data, made in another way than those that the trees are fitted on."""

    def __init__(self, seed):
        self.pick = random.Random(seed)

    def some(self, alphabet, n):
        return "".join(self.pick.choice(alphabet) for _ in range(n))

    def prose(self):
        words = "we went there in the morning and nobody had asked about it until she wrote again last week with another idea of hers".split()
        return " ".join(self.pick.choice(words) for _ in range(self.pick.randint(5, 25)))

    def planted(self):
        p, d = self.pick, lambda n: self.some("0123456789", n)
        number = p.choice(["Please phone {} after six", "Our number is {} these days", "tel. {}", "Mobile: {}", "you can reach him at {}", "her SSN, {}, was known", "Fax {}"])
        form = p.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(4)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(2)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}"])
        name = self.some("abcdefghijklmnopqrstuvwxyz", p.randint(3, 8))
        at, dot = p.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", ".")])
        secret = p.choice([self.some("0123456789abcdef", 40), self.some("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", p.randint(24, 44)), "ghp_" + self.some("abcdefghijABCDEFGHIJ0123456789", 36)])
        body = self.some("0123456789", p.choice([16, 18, 20]))
        country = p.choice(["DE", "IT", "PT", "BE"])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        iban = f"{country}{check:02d}{body}"
        iban = p.choice([iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))])
        spelled = f"{name}{p.choice(['', '.'])}{name[:2]} at {name}post dot {p.choice(['com', 'net', 'de'])}"
        path = self.some("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", p.randint(22, 40)) + "7q"
        more = [("account", p.choice(["please pay to {} by monday", "Our IBAN is {}", "account {}"]), iban), ("address", "ask {} about it", spelled), ("token", p.choice(["open https://files.example.net/get/{} now", "see http://example.com/x/{}?v=2 again"]), path)]
        return p.choice([*more, ("number", number, form), ("address", "write to {} soon", f"{name}.{name[::-1]}{at}{name}mail{dot}{p.choice(['com', 'org', 'de'])}"), ("secret", p.choice(["export API_KEY={}", 'auth_token: "{}"', "the password was {}", "Bearer {}"]), secret)])

    def text(self):
        parts, spans = [self.prose()], []
        for _ in range(3):
            kind, frame, span = self.planted()
            at = len(" ".join(parts)) + 1 + frame.index("{}")
            spans.append((kind, at, at + len(span)))
            parts += [frame.format(span), self.prose()]
        return " ".join(parts), spans


def test_added_spans_match_brute_force(spark):
    texts = pii_texts() + [TextMaker(i).text()[0] for i in range(200)] + [OtherTexts(i).text()[0] for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.detect(docs).collect()}
    assert got == {i: brute_added(t) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_planted_spans_of_another_generator_are_found(spark):
    made = [OtherTexts(1000 + i).text() for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    found, planted, wrong = Counter(), Counter(), 0
    for r in pii.detect(docs).collect():
        got = {(s["start"], s["end"]) for s in [*r["base"], *r["added"]]}
        for kind, start, end in made[r["doc_id"]][1]:
            planted[kind] += 1
            found[kind] += any(a <= start and end <= b for a, b in got)
        wrong += sum(not any(a < end and start < b for _, start, end in made[r["doc_id"]][1]) for a, b in got)
    assert all(found[k] >= 0.9 * planted[k] for k in pii.EXTRA), (found, planted)
    assert wrong <= 0.02 * sum(planted.values())


def test_things_that_are_no_personal_data_stay(spark):
    texts = ["fixed in commit 9fceb02d0ae598e95dc970b74767f19372d61af8 last week", "sha256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 of the file", "see https://news.example.org/2023/the-long-title-of-an-article-about-rain-12 there", "we met at noon. Then at example.org we read on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == dict(enumerate(texts))


def test_numbers_by_several_features():
    def used(node):
        return set() if isinstance(node, int) else {node[0]} | used(node[2]) | used(node[3])

    for kind in pii.EXTRA:
        assert len(set().union(*map(used, pii.TREES[kind]))) >= 4, kind


def test_op9_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries_pii.op9_pii(spark, sf_dir).collect():
        spans = brute_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans + brute_added(texts[r["doc_id"]]))


def test_added_spans_hold_out(spark):
    from quern.llm.pii_train import scores

    for kind, (x, truth) in labelled(spark, 77, 600).items():
        chosen = scores(pii.TREES[kind], x) > pii.THRESHOLDS[kind]
        assert truth[chosen].mean() >= 0.93 and chosen[truth > 0].mean() >= 0.8, kind


def brute_redact(text, spans):
    out, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_matches_brute_force(spark):
    rows = [(i, t, "k") for i, t in enumerate(pii_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spans = {r["doc_id"]: [*r["base"], *r["added"]] for r in pii.detect(docs).collect()}
    out = pii.redact(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: None if t is None else brute_redact(t, spans[i]) for i, t, _ in rows}
    assert {r["lang"] for r in out} == {"k"}


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 1000, 123456])
def test_buckets_keep_six_bits(spark, value):

    assert spark.range(1).select(quality.bucket(F.lit(value).cast("long"))).first()[0] == brute_bucket(value)
