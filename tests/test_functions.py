import random

import pytest
from pyspark.sql import functions as F

from quern import models
from quern.functions import judging, metrics, prompts, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("a", "b", "em"), [(None, None, 1.0), ("", "", 1.0), ("a", "", 0.0), (" a b ", "ab", 1.0), ("a\tb", "ab", 0.0), ("x\n", "x", 1.0)])
def test_exact_match(spark, a, b, em):
    assert value(spark, metrics.exact_match(F.lit(a).cast("string"), F.lit(b).cast("string"))) == em


@pytest.mark.parametrize(("a", "b", "f1"), [(None, "", 1.0), ("a", "", 0.0), ("a a b", "a a a", 2 / 3), ("a", "b", 0.0), ("x y", "y x", 1.0), ("a a", "a", 2 / 3)])
def test_rouge1_counts_repeats(spark, a, b, f1):
    assert abs(value(spark, metrics.rouge1(F.lit(a).cast("string"), F.lit(b).cast("string"))) - f1) < 1e-12


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_the_definition():
    pick = random.Random(1)
    for _ in range(200):
        a, b = [[pick.choice("abcd") for _ in range(pick.randint(0, 80))] for _ in range(2)]
        assert metrics.lcs_length(a, b) == brute_lcs(a, b)


def test_rouge_l_edges(spark):
    rows = spark.createDataFrame([(None, None), ("", "a"), ("a b c", "a c"), ("a", "b")], "r string, g string")
    assert [round(r[0], 6) for r in rows.select(metrics.rouge_l(F.col("r"), F.col("g"))).collect()] == [1.0, 0.0, 0.8, 0.0]


DOCS = "array<struct<rank:int,filename:string,rel_path:string>>"


@pytest.mark.parametrize(
    ("gold", "docs", "recall", "mrr"),
    [
        (["a"], [(2, "a", None), (1, "b", None)], 1.0, 0.5), (["a"], [(None, "a", None), (7, "b", None)], 1.0, 0.5), (["a"], [(1, "", " a ")], 1.0, 1.0), ([], [(1, "a", None)], 0.0, 0.0),
        (None, None, 0.0, 0.0), ([""], [(1, None, None)], 1.0, 1.0), (["c"], [(1, "x", None), (1, "c", None)], 1.0, 0.5),
    ],
)
def test_retrieval_metrics(spark, gold, docs, recall, mrr):
    row = spark.createDataFrame([(gold, docs)], f"g array<string>, d {DOCS}").select(metrics.recall_hit(F.col("g"), F.col("d")), metrics.reciprocal_rank(F.col("g"), F.col("d"))).first()
    assert tuple(row) == (recall, mrr)


def test_greedy_matching(spark):
    a, b = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), F.array(F.array(F.lit(1.0), F.lit(0.0)))
    assert abs(value(spark, metrics.greedy_match_f1(a, b)) - 2 * 0.5 / 1.5) < 1e-12
    assert value(spark, metrics.embedding_similarity(F.lit(""), F.lit("x"), F.array(F.lit(1.0)), F.array(F.lit(1.0)))) == 0.0


@pytest.mark.parametrize(
    ("answer", "label", "score"),
    [('so {"score": 0.7} x', 1, 0.7), ('{"score": 7}', 1, 1.0), ('{"label": 1}', 1, 0.0), ('{"score": -2, "label": 0}', 0, 0.0), ("0.8", 1, 0.8), ("none", 0, 0.0), (None, 0, 0.0), ('{"score": ', 0, 0.0), ("it is 1", 1, 1.0), ("score is 10", 1, 1.0), ('{"label": 5}', 0, 0.0), ('{"label": 5, "score": 0.9}', 0, 0.9), ('{"score": "x"} 0.6', 1, 0.6), ('{"score": "0.6"}', 1, 0.6), ('{"score": null} 1', 1, 1.0), ('{"label": "y", "score": 0.25}', 0, 0.25)],
)
def test_judge(spark, answer, label, score):
    assert tuple(value(spark, judging.judge(F.lit(answer).cast("string")))) == (label, score)


def test_judge_strict(spark):
    assert tuple(value(spark, judging.judge(F.lit("it is 1"), loose=False))) == (0, 0.0)
    assert tuple(value(spark, judging.judge(F.lit("score = 0.7"), loose=False))) == (0, 0.0)
    assert tuple(value(spark, judging.judge(F.lit('"score" : 0.75, and so on'), loose=False))) == (1, 0.75)
    assert tuple(value(spark, judging.judge(F.lit('{"score": 0.75}'), loose=False))) == (1, 0.75)


def test_judges_by_model(spark):
    rows = spark.createDataFrame([("the cat sat", "cat"), (None, "dog")], "doc string, claim string")
    model = lambda prompts: prompts.map(lambda p: '{"score": 0.9}' if "Text: the cat" in p else "0")
    out = judging.judge_batch(rows, model, "relv", F.col("doc"), F.col("claim")).collect()
    assert [(r["pred_label"], r["prob"], r["used_chunk"], r["support"]) for r in out] == [(1, 0.9, "the cat sat", [0.9]), (0, 0.0, None, [0.0])]
    with pytest.raises(ValueError):
        judging.judge_batch(rows, model, "other", F.col("doc"), F.col("claim"))


@pytest.mark.parametrize(("answer", "useful"), [('{"is_useful": false}', False), ('```json\n{"is_useful": true}\n```', True), ("{}", False), ("not json", True), (None, True)])
def test_flags(spark, answer, useful):
    assert value(spark, judging.flag(F.lit(answer).cast("string"))) is useful


def test_critic_and_interpretation(spark):
    assert tuple(value(spark, judging.critic(F.lit('[{"iter_needed": true, "new_query": "more"}]')))) == (True, "more")
    assert tuple(value(spark, judging.critic(F.lit("[]")))) == (False, None)
    assert value(spark, judging.interpretation(F.lit("junk"))).asDict() == {"crop": "", "modelType": [], "task": [], "keyword": []}


def test_text(spark):
    wide = "　x  "
    assert value(spark, text.strip(F.lit(wide))) == "x" and value(spark, text.is_blank(F.lit(" \t"))) is True
    assert value(spark, text.words(F.lit("a b  c"))) == ["a", "b", "c"] and value(spark, text.words(F.lit(""))) == []
    assert value(spark, text.sentences(F.lit("One. Two!  Three? 四。 five"))) == ["One.", "Two!", "Three?", "四。", "five"]
    assert value(spark, text.store_name(F.lit("__a b/c.d__"))) == "cleaned_a_b_c_d"
    assert value(spark, text.unfence(F.lit("```json\n{}\n```"))) == "{}" and value(spark, text.stem(F.lit("x/y.z/p_12.md"))) == "p_12"
    keys = [value(spark, text.natural_key(F.lit(x))) for x in ("p2", "p10", "P3")]
    assert keys[0] < keys[2] < keys[1]


def test_vectors(spark):
    zero, one = F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(3.0))
    assert value(spark, vectors.cosine(zero, zero)) != value(spark, vectors.cosine(zero, zero))
    assert [value(spark, x) for x in vectors.mean_std(one)] == [2.0, 2**0.5]
    assert [value(spark, x) for x in vectors.mean_std(F.array(F.lit(4.0)))] == [4.0, 0.0]
    assert [value(spark, x) for x in vectors.mean_std(F.lit(None).cast("array<double>"))] == [0.0, 0.0]
    assert abs(sum(value(spark, vectors.softmax(one))) - 1) < 1e-12 and value(spark, vectors.argmax(F.array(F.lit(2.0), F.lit(2.0)))) == 0


def test_prompts_do_not_fill_slots_inside_values(spark):
    assert value(spark, prompts.render("declare", question=F.lit("{answer}?"), answer=F.lit("A"))).endswith("Question: {answer}?\nAnswer: A")
    assert len({name.partition("@")[0] for name in prompts.TEMPLATES}) == 21


def test_normal_tail(spark):
    assert abs(value(spark, models.normal_tail(F.lit(1.959964))) - 0.025) < 1e-6


def test_texts_of_any_kind(spark):
    given = ["null", '""', '" a b "', "12", '["x", null, "", " y "]', '{"text": "t", "content": " c "}', '{"answer": ["p", "q"]}', '{"output": null}', '{"other": 1}', "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)] + [(99, None)], "i int, t string").withColumn("v", F.parse_json("t"))
    found = {r["i"]: r["n"] for r in rows.select("i", text.normalise_any(F.col("v")).alias("n")).collect()}
    assert found == {0: "", 1: "", 2: "a b", 3: "12", 4: "x\n y", 5: "c", 6: "p\nq", 7: "", 8: '{"other":1}', 9: "", 99: ""}


def test_all_line_breaks(spark):
    from quern.operators import filters

    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x85h\u2028i\u2029j", "", "x", "x\n", "\n\n", "a\r\n\r\nHead \r\nrest\r"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.lines_kept(F.col("t")).alias("l"), filters.trim_to_header(F.col("t"), ["Head", "i"]).alias("h")).collect()
    assert {r["i"]: [x for x in r["l"] if x] for r in rows} == {i: t.splitlines(keepends=True) for i, t in enumerate(texts)}
    assert {r["i"]: r["h"] for r in rows} == {0: "i\u2029j", 1: None, 2: None, 3: None, 4: None, 5: "Head \r\nrest\r"}
