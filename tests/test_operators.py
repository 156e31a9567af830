import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern import models
from quern.operators import chunking, filters, online, records, retrieval, routing, statistics
from quern.plans import search_queries
from quern.sources import scans


def test_fixed_size_edges(spark):
    rows = [(0, None), (1, ""), (2, "a"), (3, "a b c d"), (4, "a b c d e"), (5, " a  b c d e f g h ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {}
    for r in chunking.fixed_size(docs, size=4, overlap=1).orderBy("doc_id", "pos").collect():
        out.setdefault(r["doc_id"], []).append(r["chunk"])
    assert out == {2: ["a"], 3: ["a b c d"], 4: ["a b c d", "d e"], 5: ["a b c d", "d e f g", "g h"]}
    assert chunking.fixed_size(docs, size=2, overlap=9).where("doc_id = 3").count() == 3


def test_fixed_size_covers_all_words(spark):
    text = " ".join(map(str, range(57)))
    for size, overlap in ((1, 0), (10, 3), (57, 5), (100, 1), (7, 6)):
        chunks = [r["chunk"].split() for r in chunking.fixed_size(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=size, overlap=overlap).orderBy("pos").collect()]
        assert sorted({int(w) for c in chunks for w in c}) == list(range(57)) and chunks[-1][-1] == "56" and all(c[-1] != "56" for c in chunks[:-1])


def test_recursive_chunks():
    assert chunking.recursive_chunks("", 10, 2) == []
    assert chunking.recursive_chunks("one two three four", 9, 0) == ["one two", "three", "four"]
    assert chunking.recursive_chunks("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert chunking.recursive_chunks("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    for text in ("para one\n\npara two is longer. It has two parts\nand a line", "x" * 50, "a. b. c. d"):
        assert all(len(c) <= 20 for c in chunking.recursive_chunks(text, 20, 5))


def test_lumber():
    texts = ["a b", "c d", "e f g h i", "j", "k l m"]
    assert chunking.lumber_spans(texts, 4) == [(0, 1), (2, 2), (3, 4)]
    assert chunking.lumber_spans(texts, 4, lambda group: 0) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert chunking.lumber_spans(texts, 100, lambda group: 99) == [(0, 4)] and chunking.lumber_spans(texts, 100, lambda group: None) == [(0, 4)]
    assert chunking.lumber_spans([], 4) == []


def test_semantic_groups(spark):
    rows = [("d", i, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(12)] + [("one", 0, [1.0, 0.0])] + [("z", i, [0.0, 0.0]) for i in range(3)] + [("same", i, [1.0, 1.0]) for i in range(4)]
    out = chunking.semantic_groups(spark.createDataFrame(rows, "doc string, i int, v array<double>"), "doc", "i", "v")
    found = {(r["doc"], r["i"]): r["chunk_no"] for r in out.collect()}
    assert [found["d", i] for i in range(12)] == [0] * 6 + [1] * 6 and found["one", 0] == 0 and {found["z", i] for i in range(3)} == {0}
    text = chunking.semantic(spark.createDataFrame([(*r, f"s{r[1]}") for r in rows], "doc string, i int, v array<double>, t string"), "doc", "i", "t", "v")
    assert {r["chunk"] for r in text.where("doc = 'd'").collect()} == {"s0 s1 s2 s3 s4 s5", "s6 s7 s8 s9 s10 s11"}


def test_page_merge_and_failures(spark):
    pages = spark.createDataFrame([("d", i, f"p{i}") for i in range(7)], "doc string, i int, text string")
    spans = lambda f: [(r["start_idx"], r["end_idx"]) for r in chunking.merge_pages(pages, "doc", "i", "text", f).orderBy("pos").collect()]
    assert spans(None) == [(0, 6)] and spans(lambda tail, page: True) == [(0, 2), (3, 5), (6, 6)] and spans(lambda tail, page: 1 / 0) == [(0, 6)]


def test_agentic_isolates_failures(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")
    split = lambda s: s.map(lambda p: '[{"chunk": "x"}, {"chunk": " "}, {"chunk": "y"}]' if "good" in p else "junk")
    batch = sorted(tuple(r) for r in chunking.agentic(docs, models.echo_model, split).collect())
    assert batch == [(1, "good", 0, "x"), (1, "good", 1, "y"), (2, "bad", 0, "bad")]
    assert [r["summary"] for r in chunking.agentic(docs, models.echo_model, split, keep_summary=False).where("doc_id = 2").collect()] == [""]


def test_prose(spark):
    pages = spark.createDataFrame([(1, " "), (2, "keep"), (3, "drop")], "id int, text string")
    decide = lambda s: s.map(lambda p: '{"is_useful": false}' if "drop" in p else "?")
    assert [(r["id"], r["prose"]) for r in chunking.to_prose(pages, models.echo_model, decide=decide).collect()] == [(2, "keep")]


def brute_bm25(docs, questions, k_each):
    out = []
    stores = {}
    for store, doc, tokens in docs:
        stores.setdefault(store, []).append((doc, tokens))
    for qid, q in questions:
        for store, members in stores.items():
            n, avg = len(members), sum(len(t) for _, t in members) / len(members)
            df = {}
            for _, t in members:
                for w in set(t):
                    df[w] = df.get(w, 0) + 1
            idf = {w: float(np.log((n - d + 0.5) / (d + 0.5))) for w, d in df.items()}
            floor = 0.25 * sum(idf.values()) / len(idf)
            score = {doc: sum((idf[w] if idf[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q if w in t) for doc, t in members}
            out += [(qid, store, doc, round(score[doc], 9)) for doc in sorted(score, key=lambda d: (-round(score[d], 9), -d))[:k_each]]
    return sorted(out)


def test_bm25_matches_the_definition(spark):
    pick = random.Random(2)
    docs = [(f"s{i % 3}", i, [pick.choice("abcdefghij") for _ in range(pick.randint(1, 12))]) for i in range(30)] + [("tiny", 99, ["zz"])]
    questions = [(q, [pick.choice("abcdefghijq") for _ in range(4)]) for q in range(6)] + [(7, ["a", "a", "b"]), (8, ["nothing"])]
    index = retrieval.lexical_index(spark.createDataFrame([(s, d, " ".join(t)) for s, d, t in docs], "source string, doc_id long, text string"))
    asked = spark.createDataFrame([(q, " ".join(t)) for q, t in questions], "item_id long, text string")
    got = retrieval.lexical_topk(index, asked, 4, None).collect()
    assert sorted((r["qid"], r["store"], r["doc"], round(r["score"], 9)) for r in got) == brute_bm25(docs, questions, 4)
    assert {r["rank"] for r in retrieval.lexical_topk(index, asked, 4, 5).collect()} == {1, 2, 3, 4, 5}
    in_blocks = retrieval.lexical_topk(index, asked, 4, None, max_query_bytes=8 * 8 * 8).collect()  # a few questions at a time
    assert sorted((r["qid"], r["store"], r["doc"], round(r["score"], 9)) for r in in_blocks) == brute_bm25(docs, questions, 4)
    with pytest.raises(ValueError):
        retrieval.lexical_topk(index, asked, max_query_bytes=10)
    assert index.postings().where("store = 's0'").groupBy("doc").agg(F.sum("tf").alias("n")).join(index.docs, "doc").where("n <> length").count() == 0


def test_dense_search_matches_the_definition(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), int(i % 4)) for i in range(60)] + [(90, [0.0] * 8, 1), (91, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = retrieval.dense_topk(vectors, vectors.where("vec_id < 5"), 2, 5).collect()
    for q in range(5):
        sims = {i: float(np.dot(rows[q][1], v) / np.linalg.norm(rows[q][1]) / np.linalg.norm(v)) for i, v, _ in rows[:60]}
        best = [d for s in range(4) for d in sorted((i for i in sims if i % 4 == s), key=lambda i: -sims[i])[:2]]
        want = sorted(best, key=lambda d: -sims[d])[:5]
        assert [r["doc"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want
    plain = lambda d: sorted((r["qid"], r["rank"], r["store"], r["doc"], round(r["score"], 12)) for r in d.collect())
    assert plain(retrieval.dense_topk(vectors, vectors.where("vec_id < 5"), 2, 5, max_query_bytes=3 * 8 * 8)) == plain(retrieval.dense_topk(vectors, vectors.where("vec_id < 5"), 2, 5))
    assert retrieval.dense_topk(vectors, vectors.where("false")).count() == 0


def test_tasks_of_dense_search_give_few_candidates(spark, monkeypatch):
    """No more than what can be among the best of all, however many slices a task cuts its vectors into."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 10) for i in range(3000)], "vec_id long, embedding array<double>, label int").repartition(2)
    counts, top = [], retrieval._top

    def counted(blocks, search, *more):
        return top(((counts.append(search(b).count()), b)[1] for b in blocks), search, *more)

    monkeypatch.setattr(retrieval, "_top", counted)
    assert retrieval.dense_topk(vectors, vectors).count() == 5 * 3000
    assert counts == [2 * 3000 * 5]


def test_retrieval_scores_hold_few_candidates(spark, monkeypatch, tmp_path):
    """As for dense_topk_merge: what is judged comes from few candidates too."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), i % 10) for i in range(40000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    counts, top = [], retrieval._top

    def counted(blocks, search, *more):
        return top(((counts.append(search(b).count()), b)[1] for b in blocks), search, *more)

    monkeypatch.setattr(retrieval, "_top", counted)
    assert search_queries.retrieval_scores(spark, str(tmp_path)).count() == 2000
    assert len(counts) == 1 and counts[0] <= 2 * 2000 * 5


@pytest.mark.parametrize("top_k", [None, 1, 5])
def test_nearest_keeps_what_all_tasks_need(monkeypatch, top_k):
    monkeypatch.setattr(retrieval, "MAX_CELLS", 200)
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 40, size=(400, 6)) / 40  # many ties
    scores[rng.random(scores.shape) < 0.05] = np.nan
    stores = [f"s{i}" if i else None for i in rng.integers(0, 5, 400)]

    def best(rows):  # (query, store, doc, score) as windows over all stores choose them
        found = []
        for q in range(6):
            mine = [r for r in rows if r[0] == q]
            firsts = [(r, n) for s in set(stores) for n, r in enumerate(sorted((r for r in mine if r[1] == s), key=lambda r: (-r[3], r[2]))[:3])]
            found += [r for r, _ in sorted(firsts, key=lambda f: (-f[0][3], f[0][1] or "", f[1]))[:top_k]]
        return sorted(found, key=repr)

    kept = []
    for task in range(3):
        nearest = retrieval._Nearest(6, 3, top_k)
        for at in range(task * 7, 400, 21):
            nearest.add(stores[at : at + 7], np.arange(at, min(at + 7, 400)), scores[at : at + 7])
        kept += [(r["qid"], r["store"], r["doc"], r["score"]) for b in nearest.batches(np.arange(6), pa.string()) for r in b.to_pylist()]
    assert best(kept) == best([(q, stores[i], i, float(scores[i, q])) for i in range(400) for q in range(6) if scores[i, q] == scores[i, q]])


def test_context(spark):
    found = spark.createDataFrame([(1, 2, 20), (1, 1, 10), (1, 3, 30)], "qid int, rank int, doc long")
    contents = spark.createDataFrame([(10, "ten"), (20, ""), (30, "thirty")], "doc_id long, text string")
    assert tuple(retrieval.gather_context(found, contents).first()) == (1, "ten\n\nthirty", [10, 20, 30])
    everyone = retrieval.gather_context(found, contents, questions=spark.createDataFrame([(1,), (2,)], "qid int"))
    assert sorted(map(tuple, everyone.collect())) == [(1, "ten\n\nthirty", [10, 20, 30]), (2, "", [])]
    row = spark.range(1).select(retrieval.with_readings(F.lit("c"), env=F.lit("warm"), light=F.lit("")).alias("c")).first()
    assert row["c"] == "c\n\n[env]\nwarm"


@pytest.mark.parametrize(("score", "kept"), [(0.89994, False), (0.89996, True), (0.9, True), (float("nan"), False), (None, False)])
def test_thresholds_round_first(spark, score, kept):
    assert spark.range(1).select(filters.reaches(F.lit(score).cast("double"), 0.9).alias("k")).first()["k"] is kept


def test_filters(spark):
    trim = lambda t: spark.range(1).select(filters.trim_to_header(F.lit(t), ["# Top"]).alias("t")).first()["t"]
    assert trim("x\n # Top \ny") == " # Top \ny" and trim("x") is None
    useful = lambda t: spark.range(1).select(filters.looks_useful(F.lit(t)).alias("t")).first()["t"]
    assert useful("This is a sentence that says something.") and not useful("Title only") and not useful("Again and again. " * 10) and not useful("| - | - | - | - | - | - |")
    rows = spark.createDataFrame([("c", None, "a"), ("c", None, "a"), ("d", "q", "a")], "c string, q string, a string")
    assert filters.null_safe_semi(rows, rows.where("q is null"), ["c", "q", "a"]).count() == 2
    left = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.5, 0.5, 0.0],)], "p array<double>")
    assert [r[0] for r in left.select(filters.nli_class(F.col("p"))).collect()] == ["neutral", "entailment"]
    with pytest.raises(ValueError):
        filters.nli_premises("?")
    picked = spark.createDataFrame([({"a": "1", "b": "2"},)], "m map<string,string>").select(filters.pick_keys(F.col("m"), ["a"]), filters.pick_keys(F.col("m"), [])).first()
    assert tuple(picked) == ({"a": "1"}, {"a": "1", "b": "2"})


def test_running_ids_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert all(r["k"] == r["id"] - 1 for r in records.running_ids(rows, ["k"], 1).collect())
    assert records.running_ids(rows.where("false"), ["k"]).count() == 0


def test_answers_see_the_whole_context(spark, tmp_path, monkeypatch):
    from quern.plans import search_queries

    spark.createDataFrame([(1, "a", "word " * 1000 + "end")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "which word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(search_queries.models, "echo_model", lambda prompts: prompts.str.contains("word end").astype(str))
    assert [r["generated"] for r in search_queries.rag_answer(spark, str(tmp_path)).collect()] == ["True"]


def test_registered_questions_are_of_every_chunk(spark, tmp_path):
    from quern.plans.answer_queries import qa_generate

    spark.range(1200).selectExpr("id AS doc_id", "'s' AS source", "concat('text number ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert qa_generate(spark, str(tmp_path)).select("chunk_name").distinct().count() == 1200


def test_questions_from_models(spark):
    chunks = spark.createDataFrame([("b", ["f"], "Some text. A longer sentence here.", None), ("a", ["f"], "bad", "s")], "chunk_name string, source_files array<string>, raw_chunk string, md_summary string")
    answer = lambda s: s.map(lambda p: "oops" if p.endswith("bad") else json.dumps([{"question": "q1", "answer": "1"}, {"question": "q2", "answer": "2"}]))
    assert [(r["id"], r["chunk_name"], r["question"]) for r in records.questions_from_chunks(chunks, answer).orderBy("id").collect()] == [(0, "b", "q1"), (1, "b", "q2")]
    assert records.questions_from_chunks(chunks, answer, max_qa=1).count() == 1
    pairs = spark.createDataFrame([(0, "a", "b", "x", "bad"), (1, "c", "d", "x", "y")], "pair long, key_a string, key_b string, text_a string, text_b string")
    assert [(r["id"], r["ref_name_a"], r["question"]) for r in records.questions_from_pairs(pairs, answer).orderBy("id").collect()] == [(1, "c", "q1"), (2, "c", "q2")]


def test_shapes(spark):
    docs = F.array(F.struct(F.lit(2).alias("rank"), F.lit("b").alias("rel_path"), F.lit("x\n\n y ").alias("content")), F.struct(F.lit(1).alias("rank"), F.lit("a").alias("rel_path"), F.lit("z").alias("content")))
    row = spark.range(1).select(*records.shape_answer("gate_rag", F.lit("g"), docs, records.judge_scores(know_prob=F.lit(0.5)))).first().asDict(recursive=True)
    assert row["retrieved"] == [{"rel_path": "a", "rank": 1, "content": ["z"]}, {"rel_path": "b", "rank": 2, "content": ["x", "y"]}] and row["judge_score"] == [{"know_prob": 0.5}]
    assert len(records.shape_answer("sota", F.lit("g"), docs)) == 2
    assert spark.range(1).select(records.merge_prediction(F.lit(""), F.lit("given"))).first()[0] == "given"
    shaped = records.shape_question(spark.createDataFrame([(1, "q", None)], "id long, question string, answer string")).first()
    assert tuple(shaped) == (1, "q", "", "")


def test_gates_at_their_limits(spark):
    at = lambda *v, **k: spark.range(1).select(routing.gate(*(F.lit(x) if x is not None else None for x in v), **k).alias("r")).first()["r"]
    assert at(0.7, 0.0, 0.0, True) == "llm" and at(0.69, 0.7, 1.0, True) == "fallback" and at(0.0, 0.71, 0.7, True) == "rag" and at(0.0, 0.71, 0.69, True) == "fallback"
    assert at(1.0, 1.0, 1.0, False) == "llm" and at(0.69, 1.0, 1.0, False) == "empty_context"  # what the model knows needs no context
    assert at(None, 0.8, 0.8, True) == "rag" and at(None, 0.8, 0.8, False) == "empty_context"
    assert spark.range(1).select(routing.rerank_gate(F.get(F.array(F.lit(0.9), F.lit(0.1)), 0)), routing.rerank_gate(F.lit(0.1), has_fallback=False), routing.rerank_gate(F.lit(None).cast("double"))).first()[:] == ("rag", "rag", "fallback")
    branches = {"llm": lambda d: d.withColumn("generated", F.lit("m"))}
    rows = spark.createDataFrame([(1, "llm"), (2, "rag"), (3, None)], "id int, route string")
    assert sorted((r["id"], r["generated"]) for r in routing.answer_by_route(rows, "route", branches).collect()) == [(1, "m"), (2, None), (3, None)]


def test_iteration_stops_at_its_limit(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "stop")], "qid int, question string")
    critique = F.struct((F.col("question") != "stop").alias("iter_needed"), F.concat("asked", F.lit("+")).alias("new_query"))
    out = routing.iterate(questions, lambda d: d.withColumn("generated", F.col("asked")), lambda d: d.withColumn("critique", critique))
    assert sorted((r["qid"], r["question"], r["generated"], r["rounds"]) for r in out.collect()) == [(1, "a", "a++", 3), (2, "stop", "stop", 1)]


def test_rate_limit_rules():
    assert online.accepted([0, 1, 2, 3, 60, 60.5, 61], 3)[0] == [True, True, True, False, True, False, True]
    assert online.accepted([0, 60], 1)[0] == [True, True] and online.accepted([0, 59.9], 1)[0] == [True, False]


def test_requests(spark):
    check = lambda *v: tuple(spark.range(1).select(online.check_request(*(F.lit(x).cast("string") for x in v)).alias("c")).first()["c"])
    assert check(" ", "f", "h", "b") == ("E", None, "empty question") and check("x" * 201, None, None, None)[2] == "question too long"
    assert check("q", "f", "h", "b") == ("S", "readings", "ok") and check("q", "f", "", "b")[1] == "documents"


def brute_box(xs):
    xs = sorted(xs)
    n = len(xs)
    depth = (n + 3) // 2 / 2
    at = lambda d: (xs[int(d) - 1] + xs[int(-(-d // 1)) - 1]) / 2
    q1, median, q3 = at(depth), at((n + 1) / 2), at(n + 1 - depth)
    inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    return n, inside[0], q1, median, q3, inside[-1], n - len(inside)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 31])
def test_box_stats(spark, n):
    pick = random.Random(n)
    xs = [float(pick.randint(0, 9)) for _ in range(n)] + [100.0] * (n > 7)
    r = statistics.box_stats(spark.createDataFrame([("m", "x", x) for x in xs] + [("m", "x", None)], "metric string, method string, score double")).first()
    assert (r["n"], r["whisker_low"], r["q1"], r["median"], r["q3"], r["whisker_high"], r["n_outliers"]) == brute_box(xs)


def brute_wilcoxon(d):
    d = [x for x in d if x]
    order = sorted(map(abs, d))
    rank = lambda x: (order.index(abs(x)) + 1 + len(order) - order[::-1].index(abs(x))) / 2
    v, m = sum(rank(x) for x in d if x > 0), len(d)
    ties = sum(c**3 - c for c in (order.count(x) for x in set(order)))
    centred = v - m * (m + 1) / 4
    return v, (centred - np.sign(centred) * 0.5) / np.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)


def test_wilcoxon(spark):
    pick = random.Random(3)
    rows = [(float(pick.randint(0, 6)), float(pick.randint(0, 5))) for _ in range(40)]
    wide = spark.createDataFrame(rows + [(None, 1.0)], "s_A double, s_B double").withColumn("t_A", F.lit(1.0)).withColumn("t_B", F.lit(1.0))
    got = {r["metric"]: r for r in statistics.with_p_value(statistics.wilcoxon(wide, ["s", "t"], "A", "B")).collect()}
    v, z = brute_wilcoxon([a - b for a, b in rows])
    assert got["s"]["n"] == 40 and got["s"]["v"] == v and abs(got["s"]["z"] - z) < 1e-12 and 0 < got["s"]["p"] <= 1
    assert got["t"]["n"] == 41 and got["t"]["v"] == 0 and got["t"]["z"] is None


def test_holm(spark):
    rows = statistics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "metric string, p double"))
    assert {r["metric"]: round(r["p_holm"], 6) for r in rows.collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}


def test_scores_add_up_in_any_number_of_steps(monkeypatch):
    draw = np.random.default_rng(5)
    matrix = draw.integers(0, 3, (30, 9)) * (draw.random((30, 9)) < 0.3)
    owner, number = np.sort(draw.integers(0, 20, 200)), draw.integers(0, 30, 200)
    gains = draw.random(200)
    want = np.zeros((20, 9))
    np.add.at(want, owner, gains[:, None] * matrix[number])
    term, asked = np.nonzero(matrix)
    for cells in (1, 7, 1 << 20):
        monkeypatch.setattr(retrieval, "MAX_CELLS", cells)
        found = retrieval._summed(20, 9, owner, number, gains, np.searchsorted(term, np.arange(31)), asked, matrix[term, asked].astype(float))
        assert np.allclose(found, want)


def test_blocks_are_searched_one_by_one(spark, monkeypatch):
    """No block is made before the one before it is written; the result is that of one block."""
    docs = spark.createDataFrame([("s", i, f"w{i % 7} w{i % 5} x") for i in range(40)], "source string, doc_id long, text string")
    questions = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(6)], "item_id long, text string")
    index = retrieval.lexical_index(docs)
    whole = sorted(map(tuple, retrieval.lexical_topk(index, questions).collect()))
    events, real_block, real_write = [], retrieval._lexical_block, retrieval.materialize
    monkeypatch.setattr(retrieval, "_lexical_block", lambda *a: events.append("block") or real_block(*a))
    monkeypatch.setattr(retrieval, "materialize", lambda df, label, *a: events.append("written") or real_write(df, label, *a))
    assert sorted(map(tuple, retrieval.lexical_topk(index, questions, max_query_bytes=48).collect())) == whole
    assert events == ["block", "written"] * 6


def test_stored_indexes(spark, tmp_path):
    """Built once for the same files, anew when they change."""
    rows = [("s", 1, "a b"), ("t", 2, "c")]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    built = []

    def opened():
        docs = spark.read.parquet(f"{tmp_path}/docs")
        return scans.stored_lexical(docs, "test", lambda folder: built.append(folder) or retrieval.lexical_index(docs, folder=folder))

    assert opened().rows.count() == 2 and opened().rows.count() == 2 and len(built) == 1
    spark.createDataFrame([("s", 3, "d")], "source string, doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/docs")
    assert opened().rows.count() == 3 and len(built) == 2


def test_threads_share_the_clean_up_setting(spark):
    from concurrent.futures import ThreadPoolExecutor

    from quern.workspace import CLEANUP, materialize

    before = spark.conf.get(CLEANUP, "false")
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda i: materialize(spark.range(i), "threads").count(), range(12)))
    assert counts == list(range(12)) and spark.conf.get(CLEANUP, "false") == before
