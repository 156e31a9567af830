import json

import pytest
from pyspark.sql import functions as F

from quern import config, models
from quern.functions import text
from quern.functions.prompts import render
from quern.operators import chunking, filters, records, retrieval
from quern.plans import drivers
from quern.sources import sinks


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    (tmp_path / "s.json").write_text(json.dumps({"path": "$PLACE/x", "k": 3, "nested": {"p": "$PLACE"}}))
    found = config.settings(str(tmp_path / "s.json"), ["--k", "5", "--unknown", "1"], k=int, path=str)
    assert (found.path, found.k, found.nested) == ("/data/x", 5, {"p": "$PLACE"})


def test_corpus_to_indexes(spark):
    pages = spark.createDataFrame([("a/1.md", "one two three"), ("b/2.md", "four five")], "rel_path string, text string")
    chunks = drivers.chunk_corpus(pages, {"fixed": lambda p: chunking.fixed_size(p, "rel_path", size=2, overlap=0), "whole": lambda p: chunking.fixed_size(p, "rel_path", size=9, overlap=0)})
    assert sorted((r["tag"], r["id"], r["chunk"]) for r in chunks.collect()) == [("fixed", 1, "one two"), ("fixed", 2, "three"), ("fixed", 3, "four five"), ("whole", 1, "one two three"), ("whole", 2, "four five")]
    lexical, dense = drivers.build_indexes(pages, [lambda d: retrieval.lexical_index(d, "store", "rel_path", "text"), drivers.dense_rows], F.split("rel_path", "/")[0])
    assert sorted(r["store"] for r in lexical.stats.collect()) == ["cleaned_a", "cleaned_b"] and dense.where(F.size("embedding") == 64).count() == 2


def test_questions_made_and_filtered(spark):
    chunks = spark.createDataFrame([("c1", ["f"], "Short. The longest sentence stands here.", "sum"), ("c2", ["f"], "Another text.", None)], "chunk_name string, source_files array<string>, raw_chunk string, md_summary string")
    made = drivers.make_questions(chunks, models.question_model, models.echo_model)
    assert sorted((r["file_name"], r["answer"]) for r in made.collect()) == [("c1_qa001.json", "The longest sentence stands here."), ("c2_qa001.json", "Another text.")]
    out = drivers.filter_questions(made, threshold=0.4)
    assert out["CD_selected"].count() + out["CD_rejected"].count() == 2 and out["final"].count() <= out["CD_selected"].count()
    assert out["ratio"].first()["total"] == 2


def test_answers_and_evaluation(spark):
    contexts = spark.createDataFrame([(1, "what is red", "red is what it is"), (2, "q", " ")], "qid long, question string, context string")
    out = {r["qid"]: r for r in drivers.answer_batch(contexts, models.echo_model, models.echo_model, relevance_at=0.1, faithfulness_at=0.0).collect()}
    assert out[1]["route"] == "rag" and out[2]["route"] == "empty_context" and out[2]["generated"] is None and out[1]["judge_score"][0]["relv_score"] > 0
    results = spark.createDataFrame([(1, "a b", "a b", ["x"], [(1, "x", None)]), (2, "a", "c", ["y"], [])], "id long, reference string, generated string, ref_docs array<string>, gen_docs array<struct<rank:int,filename:string,rel_path:string>>")
    scores, summary = drivers.evaluate(results, extra={"learned": models.overlap_scorer})
    assert {r["metric"]: round(r["average"], 9) for r in summary.collect()} == {m: 0.5 for m in ("recall", "mrr", "sbert", "rouge1", "rougeL", "em", "learned")} and scores.count() == 2


def test_each_model_sees_its_rows_only(spark, tmp_path):
    def told(name, model):
        def run(*series):
            with open(tmp_path / name, "a") as out:
                out.writelines(f"{x[-12:]!r}\n" for x in series[0])
            return model(*series)

        return run

    contexts = spark.createDataFrame([(1, "known", "x"), (2, "known too", None), (3, "bare", " "), (4, "off topic", "nothing here"), (5, "red cat", "red cat sat"), (6, "blue cat", "blue cat sat")], "qid long, question string, context string")
    know = lambda a, b: a.str.startswith("known").astype(float)
    relevance = lambda a, b: (~a.str.startswith("off")).astype(float)
    faithful = lambda a, b: a.str.startswith("red").astype(float)
    out = {r["qid"]: r for r in drivers.answer_batch(contexts, told("chat", models.echo_model), told("fallback", models.echo_model), told("know", know), told("relevance", relevance), told("faithful", faithful)).collect()}
    assert {q: r["route"] for q, r in out.items()} == {1: "llm", 2: "llm", 3: "empty_context", 4: "fallback", 5: "rag", 6: "fallback"}
    assert {q: tuple(r["judge_score"][0]) for q, r in out.items()} == {1: (1.0, None, None), 2: (1.0, None, None), 3: (0.0, None, None), 4: (0.0, 0.0, None), 5: (0.0, 1.0, 1.0), 6: (0.0, 1.0, 0.0)}
    runs = lambda name: len((tmp_path / name).read_text().splitlines())
    assert {n: runs(n) for n in ("know", "chat", "relevance", "faithful", "fallback")} == {"know": 6, "chat": 5, "relevance": 3, "faithful": 2, "fallback": 2}


def test_answers_by_tokens(spark):
    contexts = spark.createDataFrame([(1, "where is the cat", "the cat is where it was"), (2, "unrelated", None)], "qid long, question string, context string")
    out = {r["qid"]: r for r in drivers.answer_by_tokens(contexts, models.scored_echo_model, models.echo_model).collect()}
    assert out[1]["route"] == "rag" and out[1]["generated"].endswith("where is the cat") and len(out[1]["logprobs"]) == 4 and out[2]["route"] == "fallback" and out[2]["generated"] == "unrelated"


def test_names_that_nothing_has(spark):
    results = spark.createDataFrame([(1, "a b", "a b", ["x"], [(1, "x", None)])], "id long, reference string, generated string, ref_docs array<string>, gen_docs array<struct<rank:int,filename:string,rel_path:string>>")
    scores, summary = drivers.evaluate(results, names=["em", "mrr"])
    assert scores.columns == ["id", "mrr", "em"] and {r["metric"] for r in summary.collect()} == {"em", "mrr"}
    assert sinks.metric_rows(scores, results, "em").first().asDict() == {"em": 1.0, "id": 1, "reference": "a b", "generated": "a b"}
    with pytest.raises(ValueError):
        drivers.evaluate(results, names=["em", "other"])
    with pytest.raises(ValueError):
        text.tokenizer("other")
    assert spark.range(1).select(text.tokenizer("words")(F.lit("a  B"))).first()[0] == ["a", "B"]


def test_filters_run_once_per_key(spark):
    asked = []
    keep = filters.FilteredPages(lambda pages: asked.append(1) or pages.where("text <> ''"))
    pages = spark.createDataFrame([("a",), ("",)], "text string")
    assert keep.of("x", pages).count() == keep.of("x", pages).count() == 1 and len(asked) == 1
    assert keep.of("y", pages).count() == 1 and len(asked) == 2


def test_rerank(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "qid long, rank int, doc long")
    contents = spark.createDataFrame([(10, "no match"), (20, "the red car")], "doc long, content string")
    out = drivers.rerank(found, spark.createDataFrame([(1, "red car")], "qid long, question string"), contents)
    assert [(r["doc"], r["rank"]) for r in out.orderBy("rank").collect()] == [(20, 1), (10, 2)]


def test_requests(spark):
    requests = spark.createDataFrame([("q", "f", "h", "b"), ("", None, None, None)], "query_rag string, farm_cd string, house_cd string, basetime string")
    series = {"climate": spark.createDataFrame([("f", "h", 1, 20.0), ("f", "h", 2, 21.5)], "farm_cd string, house_cd string, ts int, temp double")}
    rows = drivers.serve(drivers.enrich_requests(requests, series), lambda d: d.withColumn("generated", F.concat(F.lit("t="), F.col("climate.temp")))).collect()
    assert sorted(json.loads(r["response"]).get("llmAnswer", "-") for r in rows) == ["-", "t=21.5"] and {r["mode"] for r in rows} == {"readings", None}


def test_choice_questions_keep_their_form(spark):
    answers = {
        "good": [{"question": "q?", "options": [f"{i}) o{i}" for i in range(1, 6)], "answer": "3"}],
        "four": [{"question": "q?", "options": [f"{i}) o{i}" for i in range(1, 5)], "answer": "3"}],
        "digit": [{"question": "q?", "options": [f"{i}) o{i}" for i in range(1, 6)], "answer": "6"}],
        "blank": [{"question": " ", "options": [f"{i}) o{i}" for i in range(1, 6)], "answer": "1"}],
        "null": [{"question": None, "options": None, "answer": None}],
    }
    model = lambda prompts: prompts.map(lambda p: "```json\n" + json.dumps(answers[p.rsplit("\n", 1)[1]]) + "\n```" if p.rsplit("\n", 1)[1] in answers else "no list")
    chunks = spark.createDataFrame([(f"c{i}", name) for i, name in enumerate([*answers, "other", "good"])] + [("c9", None)], "chunk_name string, raw_chunk string")
    found = [tuple(r) for r in records.choice_questions(chunks, model).orderBy("id").collect()]
    options = [f"{i}) o{i}" for i in range(1, 6)]
    assert found == [(0, "c0", "q?", options, "3", "o3"), (1, "c6", "q?", options, "3", "o3")]


def test_cited_questions_keep_what_stands_in_the_notes(spark):
    quote = lambda source, text: {"source": source, "text": text}
    said = [
        {"sentence": "both", "reference": [quote("a", "red"), quote("b", "sky")]},
        {"sentence": "wrong note", "reference": [quote("b", "red")]},
        {"sentence": "one of two", "reference": [quote("a", "red"), quote("a", "blue")]},
        {"sentence": "none", "reference": []},
        {"sentence": "empty", "reference": [quote("a", "")]},
        {"sentence": "null", "reference": [quote("a", None)]},
        {"sentence": "missing"},
    ]
    answer = json.dumps([{"question": "q1", "answer": said}, {"question": "q2", "answer": said[1:]}, {"question": None, "answer": said}])
    books = spark.createDataFrame([("n1", [("a", "a red rose"), ("b", "the sky"), (None, None)]), ("n2", []), ("n3", None)], "notebook string, notes array<struct<source: string, text: string>>")
    found = records.cited_questions(books, lambda prompts: prompts.map(lambda p: answer)).collect()
    assert [(r["id"], r["notebook"], r["question"], [s["sentence"] for s in r["sentences"]]) for r in found] == [(0, "n1", "q1", ["both"])]


def test_question_types_are_put_together(spark):
    rows = spark.createDataFrame([(1, "why?", "because", "x"), (2, None, None, "y")], "id long, question string, context string, more string")
    plain = drivers.QuestionType(lambda d: render("answer", question=F.col("question")), records.shape_question)
    assert [tuple(r) for r in plain.answer(rows, models.echo_model).orderBy("id").collect()] == [(1, "why?", "", "", "why?", "llm"), (2, None, "", "", "Answer the question.", "llm")]
    by_context = plain.taking(lambda d: d.select("id", "context")).giving(lambda a: records.shape_answer("gate_rag", a, scores=records.judge_scores(s=F.lit(0.5))))
    by_context = drivers.QuestionType(lambda d: F.col("context"), by_context.inputs, by_context.outputs)
    found = by_context.answer(rows, models.echo_model).orderBy("id").collect()
    assert found[0]["generated"] == "because" and found[0]["agent"] == "gate_rag" and found[0]["judge_score"][0]["s"] == 0.5 and found[0].asDict().keys() == {"id", "context", "generated", "agent", "judge_score"}
