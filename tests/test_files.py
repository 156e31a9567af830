import json

from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.plans import text_queries
from quern.sources import readings, scans, sinks
from quern.streaming import live
from quern.workspace import materialize, shared_dir


def test_markdown_scan(spark, tmp_path):
    for name, text in (("a/p10.md", "ten"), ("a/p2.md", "two"), ("b.md", " \n"), ("c.txt", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    pages = scans.markdown_pages(spark, [str(tmp_path), str(tmp_path / "missing")])
    assert [(r["rel_path"], r["text"]) for r in pages.orderBy("sort_key").collect()] == [("a/p2.md", "two"), ("a/p10.md", "ten")]
    assert scans.index_rows(pages).columns == ["filename", "source", "rel_path", "type", "text"] and scans.markdown_pages(spark, ["/nowhere"]).count() == 0


def test_written_files_are_opened_by_name(spark, sf_dir, tmp_path):
    """No folder of all files is listed, which the driver would hold."""
    rows = spark.createDataFrame([("a b/x%20.md", "one"), ("c/é_10.md", " \n"), ("c/y_2.md", "two\n"), ("c/y_2.md", "two\n")], "rel_path string, text string").repartition(1)
    folder = str(tmp_path / "written")
    pages = scans.written_pages(sinks.write_files(rows, folder), folder)
    assert sorted((r["path"], r["rel_path"], r["stem"], r["text"]) for r in pages.collect()) == [(f"{folder}/a b/x%20.md", "a b/x%20.md", "x%20", "one"), (f"{folder}/c/y_2.md", "c/y_2.md", "y_2", "two\n")]
    assert pages.schema == scans.markdown_pages(spark, ["/nowhere"]).schema
    layout = text_queries.prose_layout(spark, sf_dir)
    assert len([f for f in layout.inputFiles() if f.endswith(".md")]) == 0 < layout.count()


def test_record_files(spark, tmp_path):
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "b.json").write_text(json.dumps([{"question": "q2"}, {"no": 1}, {"question": "q3"}]))
    (tmp_path / "qa" / "a.json").write_text(json.dumps({"id": 9, "question": "q1"}))
    assert [(r["id"], r["question"]) for r in scans.qa_files(spark, str(tmp_path / "qa")).orderBy("id").collect()] == [(0, "q1"), (1, "q2"), (2, "q3")]
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "x_001.json").write_text(json.dumps({"id": 1, "source_files": ["a", "b"], "raw_chunk": "text"}))
    (tmp_path / "chunks" / "x_002.json").write_text(json.dumps({"id": 2, "raw_chunk": " "}))
    assert [(r["chunk_id"], r["original_id"], r["source_list"]) for r in scans.chunk_files(spark, str(tmp_path / "chunks")).collect()] == [("x_001__c001", "1", "a, b")]
    (tmp_path / "raw.bin").write_bytes(b"ok\xff!")
    assert scans.decoded_files(spark, str(tmp_path), "raw.bin").first()["text"] == "ok!"
    (tmp_path / "s.csv").write_text("setting,qid,bertscore,sbert,rouge1,rougeL\nrag,1,0.5,,1,0\n")
    assert tuple(scans.score_table(spark, str(tmp_path / "s.csv")).first()) == ("rag", "1", 0.5, None, 1.0, 0.0)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "r.json").write_text(json.dumps({"question": "q", "retrieved": [{"rel_path": "a", "rank": 1, "content": ["x"]}]}))
    row = scans.prediction_files(spark, str(tmp_path / "p")).first()
    assert row["id"] == 0 and row["retrieved"][0]["rel_path"] == "a"


def test_page_images(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"xy")
    pages = scans.rendered_pages(spark, str(tmp_path), lambda content, dpi: [(i + 1, "p", bytes([c])) for i, c in enumerate(content)])
    read = scans.recognized_text(pages, lambda image: (image.decode().upper(), "{}"))
    assert sorted((r["page_no"], r["markdown"]) for r in read.collect()) == [(1, "X"), (2, "Y")]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("s", "a", 1, "old"), ("s", "b", 1, "b")], "store string, rel_path string, version int, content string")
    sinks.write_vectors(spark.createDataFrame([("s", "a", 2, "new"), ("t", "c", 1, "c")], old.schema), str(tmp_path / "v"), old)
    table, stores = scans.open_stores(spark, str(tmp_path / "v"))
    assert stores == ["s", "t"] and sorted(r["content"] for r in table.collect()) == ["b", "c", "new"]
    index = retrieval.lexical_index(spark.createDataFrame([("s", 1, "a a b")], "source string, doc_id long, text string"))
    sinks.write_lexical(index, str(tmp_path / "lex"))
    opened = scans.open_lexical(spark, str(tmp_path / "lex"))
    assert sorted((r["term"], r["tf"]) for r in opened.postings().collect()) == [("a", 2), ("b", 1)]
    asked = spark.createDataFrame([(1, "b a")], "item_id long, text string")
    assert retrieval.lexical_topk(opened, asked).collect() == retrieval.lexical_topk(index, asked).collect()
    chunks = sinks.chunk_records(spark.createDataFrame([("f", 0, "x"), ("f", 1, "y")], "file string, pos int, raw_chunk string"), ["file", "pos"], "fixed")
    assert sorted((r["id"], r["file_name"]) for r in chunks.collect()) == [(1, "fixed_001.json"), (2, "fixed_002.json")]
    sinks.write_records(chunks.withColumn("none", F.lit(None).cast("string")), str(tmp_path / "rec"), "tag")
    assert spark.read.json(str(tmp_path / "rec")).columns == ["file", "file_name", "id", "pos", "raw_chunk", "tag"]
    sinks.write_csv(chunks.select("id"), str(tmp_path / "csv"))
    sinks.write_trimmed(spark.createDataFrame([("doc_12", "t")], "stem string, text string"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).first()["group"] == "doc"
    average, deviation = sinks.summary_sheets(spark.createDataFrame([("em", 0.5, 0.1), ("mrr", 1.0, 0.0)], "metric string, average double, std double"))
    assert average.first().asDict() == {"em": 0.5, "mrr": 1.0} and deviation.first()["em"] == 0.1


def test_group_folder(spark):
    folders = spark.createDataFrame([("doc_7_a", "z"), ("doc_7", "y"), ("other", "x")], "stem string, folder string")
    rows = spark.createDataFrame([("doc_7_q",), ("none_1",)], "chunk_name string")
    assert {r["chunk_name"]: r["folder"] for r in sinks.group_folder(rows, folders).collect()} == {"doc_7_q": "y", "none_1": "."}


def test_readings(spark, monkeypatch):
    assert readings.rows_of({"status": "S", "dataList1": [{"a": 1}]}) == [{"a": 1}] and readings.rows_of({"status": "E", "dataList1": [1]}) == [] and readings.rows_of({"status": "S"}) == []
    monkeypatch.setattr(readings, "post", lambda url, body: {"status": "S", "dataList1": [{"t": 1, "n": None}]})
    reader = readings.Readings({"url": "http://x", "asks": '[["f", "h", "b"]]'}).reader(None)
    assert [list(reader.read(p)) for p in reader.partitions()] == [[("f", "h", "b", 0, {"t": "1"})]]


def test_ingest_new(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(6)], "n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        live.ingest_new(spark, str(tmp_path / "in"), "n long", str(tmp_path / "c2"), lambda batch, n: seen.append(batch.count()))
    assert seen == [6]


def test_shared_tables(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3).where("false"), "t").count() == 0 and materialize(spark.range(3), "t").count() == 3
