"""Cuts by cohesion, token matching, table functions and the stateful limiter, against brute force and replays."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from quern.functions import matching
from quern.functions.table_functions import register_chunkers
from quern.operators import chunking, cohesion, online
from quern.streaming import live

# -- cohesion


def brute_cost(units, spans):
    tokens = [w for u in units for w in u]
    k, total = len(set(tokens)) or 1, 0.0
    for a, b in spans:
        words = [w for u in units[a : b + 1] for w in u]
        total += len(words) * math.log(len(words) + k) - sum(words.count(w) * math.log(words.count(w) + 1) for w in set(words)) + math.log(max(len(tokens), 1))
    return total


def brute_best(units, longest, least):
    n, best = len(units), math.inf
    for r in range(n):
        for cuts in combinations(range(1, n), r):
            ends = [0, *cuts, n]
            spans = [(a, b - 1) for a, b in zip(ends, ends[1:])]
            if all(least <= b - a + 1 <= longest for a, b in spans):
                best = min(best, brute_cost(units, spans))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    draw = random.Random(seed)
    longest, least = draw.choice([(9, 1), (3, 1), (4, 2), (9, 3)])
    units = [draw.choices("abcdefgh"[: draw.choice([3, 8])], k=draw.randint(0, 6)) for _ in range(9)]
    spans = cohesion.best_spans(units, longest, least)
    assert [a for a, _ in spans] == [0, *(b + 1 for _, b in spans[:-1])] and spans[-1][1] == 8
    assert abs(brute_cost(units, spans) - brute_best(units, longest, least)) < 1e-9


def test_planted_boundaries_are_found():
    """Stretches with words of their own beside common ones."""
    draw, found, planted = random.Random(2), 0, 0
    for _ in range(60):
        units, ends = [], []
        for topic in range(draw.randint(2, 5)):
            own = [f"t{topic}-{i}" for i in range(12)]
            units += [draw.choices(own, k=6) + draw.choices("abcdef", k=6) for _ in range(draw.randint(4, 9))]
            ends.append(len(units) - 1)
        cut = {b for _, b in cohesion.best_spans(units)}
        found += len(cut & set(ends[:-1])) - len(cut - set(ends))
        planted += len(ends) - 1
    assert found >= 0.9 * planted


def test_cohesion_edges(spark):
    assert cohesion.best_spans([]) == [] and cohesion.best_spans([["a"]], least=3) == [(0, 0)]
    assert cohesion.best_spans([[], [], []]) == [(0, 2)]
    assert cohesion.best_spans([["a"]] * 7, longest=3, least=3) == [(0, 2), (3, 6)]  # seven units are no threes: the last stretch is longer
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One.", 0), (None, "A b. " * 400, 0), (4, "a. " * 3, 1), (4, "a. " * 3, 1)], "doc_id long, text string, pos int").select("doc_id", "text")
    rows = cohesion.cohesive_chunks(docs).collect()
    assert {r["doc_id"] for r in rows} == {3, 4, None} and sum(r["doc_id"] == 4 for r in rows) % 2 == 0
    pages = spark.createDataFrame([("d", 2, "a a a"), ("d", 1, None), ("d", 3, "a a"), ("e", 1, "x")], "doc string, page int, text string")
    assert sorted(map(tuple, cohesion.cohesive_pages(pages, "doc", "page", "text").collect())) == [("d", 0, 0, 2, "\na a a\na a"), ("e", 0, 0, 0, "x")]


# -- token matching


def brute_match(reference, generated, weight):
    if not reference or not generated:
        return float(not reference and not generated)

    def cos(a, b):
        x, y = matching.letter_vectors([a, b])
        return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))

    def side(xs, ys):
        return sum(weight(x) * max(cos(x, y) for y in ys) for x in xs) / sum(map(weight, xs))

    p, r = side(generated, reference), side(reference, generated)
    return 2 * p * r / (p + r)


@pytest.mark.parametrize("block", [2, 512])
def test_token_matching(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    draw = random.Random(block)
    rows = [(i, *(" ".join(draw.choices(["ab", "abc", "zz", "é", "x1", "long"], k=draw.choice([0, 3, 8]))) for _ in range(2))) for i in range(30)]
    rows += [(100, None, " "), (101, None, "a"), (102, "a", ""), (103, "a" * 2000 + " " + "b" * 5000, "b" * 999), (103, "x", "x"), (None, "x y", "y x")]
    pairs = spark.createDataFrame(rows, "id long, reference string, generated string")
    plain = sorted(map(tuple, matching.token_match(pairs, "id", "reference", "generated").collect()), key=str)
    tokens = lambda text: (text or "").strip()[:3000].lower().split()
    close = lambda found, wanted: [(i, round(x, 9)) for i, x in found] == sorted(((i, round(x, 9)) for i, x in wanted), key=str)
    assert close(plain, [(i, brute_match(tokens(r), tokens(g), lambda t: 1.0)) for i, r, g in rows])
    weights, unseen = matching.inverse_frequencies(pairs, "reference")
    df = {t: sum(t in tokens(r) for _, r, _ in rows) for _, r, _ in rows for t in tokens(r)}
    weighed = sorted(map(tuple, matching.token_match(pairs, "id", "reference", "generated", weights=weights, unseen=unseen).collect()), key=str)
    assert close(weighed, [(i, brute_match(tokens(r), tokens(g), lambda t: math.log((len(rows) + 1) / (df.get(t, 0) + 1)))) for i, r, g in rows])


# -- table functions


def test_chunkers_in_sql(spark):
    register_chunkers(spark)
    rows = [(1, "one two three\x0bfour five  six", "en"), (2, None, "en"), (3, "", "de"), (4, "a\x1cb c", None), (None, "Long text. " * 30, "en"), (1, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.createOrReplaceTempView("sql_docs")
    for call, frame in ((("chunk_words", 3, 1), chunking.fixed_size(docs, size=3, overlap=1)), (("chunk_recursive", 40, 10), chunking.recursive(docs, size=40, overlap=10))):
        name, size, overlap = call
        found = spark.sql(f"SELECT * FROM {name}(TABLE(sql_docs), 'text', {size}, {overlap})")
        assert found.columns == ["doc_id", "lang", "pos", "chunk"]
        assert sorted(map(str, found.select("doc_id", "pos", "chunk").collect())) == sorted(map(str, frame.collect()))


def test_pages_merged_in_sql(spark):
    register_chunkers(spark)
    draw = random.Random(8)
    pages = [(doc, i, " ".join(draw.choices(f"{doc}abc" if i < 4 else "xyzw", k=30))) for doc in "de" for i in range(8)]
    spark.createDataFrame(pages, "doc string, page int, text string").repartition(3).createOrReplaceTempView("sql_pages")
    found = spark.sql("SELECT * FROM merge_pages(TABLE(sql_pages) PARTITION BY (doc) ORDER BY (page), 'text', 2, 24)")
    wanted = cohesion.cohesive_pages(spark.table("sql_pages"), "doc", "page", "text", least=2)
    assert sorted(map(tuple, found.select("doc", "start_idx", "end_idx", "chunk").collect())) == sorted(map(tuple, wanted.select("doc", "start_idx", "end_idx", "chunk").collect()))
    assert sorted((r["page"], r["start_idx"], r["end_idx"]) for r in found.collect()) == [(0, 0, 3), (0, 0, 3), (4, 4, 7), (4, 4, 7)]


@pytest.mark.parametrize("call", ["chunk_words(TABLE(sql_docs), 'none', 3, 1)", "chunk_words(TABLE(sql_docs), 'text', -3, 1)", "merge_pages(TABLE(sql_docs), 'text', 3, 1)", "chunk_words(TABLE(SELECT text, 1 AS pos FROM sql_docs), 'text', 3, 1)"])
def test_calls_that_are_refused(spark, call):
    register_chunkers(spark)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").createOrReplaceTempView("sql_docs")
    with pytest.raises(Exception):
        spark.sql(f"SELECT * FROM {call}")


# -- rate limits of a stream


def test_limiter_replays_the_batch(spark, tmp_path):
    """Requests in many files, out of order within the delay, the stream stopped and started again from its checkpoint on the way."""
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == live.ROCKSDB
    draw = random.Random(3)
    times = sorted(round(draw.uniform(0, 400), 3) for _ in range(240))
    requests = [(draw.choice([1, 1, 1, 2, 3]), t, i) for i, t in enumerate(times)]
    end = [(9, 5000.0, 900)]  # moves the watermark past all others
    source, schema = str(tmp_path / "in"), "user_id long, s double, event_id long"

    def arrive(rows):
        draw.shuffle(rows)
        for at in range(0, len(rows), 20):
            spark.createDataFrame(rows[at : at + 20], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = live.limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), delay="10 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrive(requests[:120])
    run()
    arrive(requests[120:])
    arrive(end)
    run()
    arrive([(9, 9000.0, 901)])
    run()
    got = {(r["user_id"], r["event_id"]): r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    frame = spark.createDataFrame(requests + end, schema).selectExpr("user_id", "event_id", "timestamp_millis(cast(round(s * 1000) as long)) as ts")
    want = {(r["user_id"], r["event_id"]): r["accepted"] for r in online.rate_limit(frame, "user_id", "ts", "event_id").collect()}
    assert {k: v for k, v in got.items() if k[0] != 9} == {k: v for k, v in want.items() if k[0] != 9} and len(got) >= 240
