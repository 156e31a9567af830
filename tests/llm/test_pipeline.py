import corpus_pipeline
import public_tokenizers
import sentencepiece
from quern.llm import pii
from test_native import brute_kept, brute_overlaps, brute_redact
from test_similar import brute_kept as brute_similar


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = brute_kept([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    texts = {d: texts[d] for d in brute_similar(sorted(texts.items()))}
    leaked = {o[0] for o in brute_overlaps(sorted(texts.items()), items)}
    texts = {d: t for d, t in texts.items() if d not in leaked}
    spans = {r["doc_id"]: [*r["base"], *r["added"]] for r in pii.detect(docs).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: library.encode(brute_redact(t, spans[d])) for d, t in texts.items()}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want and want


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns and stage(spark, docs.where("false"), sf_dir).collect() == []


#: Names that stages use for columns of their own or give to their results.
CLASHING = ("email", "ip", "card", "phone", "base", "extra", "added", "hash", "key", "t", "h", "at", "place", "item_id", "n_covered", "id", "fp", "kept", "failed", "n_words", "base_failed", "ids", "n_tokens", "component_id")


def odd_documents(spark):
    """Null and repeated ids, nulls in all other columns, empty and very long texts, ties and repeated rows, columns that clash."""
    prose = "It was a plain day in the north and the rain had come down on every field by noon, so they all went home. "
    clean = [f"{prose}Line {i} says {' '.join(f'word{i}x{j}' for j in range(60))}." for i in range(12)]
    rows = [(i, clean[i], "en", "a", len(clean[i])) for i in range(6)]
    rows += [(None, clean[6], "en", None, 7), (None, clean[7], None, "a", None), (8, clean[8], "en", "a", 1), (8, clean[9], "en", "a", 1), (8, clean[9], "en", "a", 1)]
    rows += [(20, None, "en", "a", None), (21, "", None, None, 0), (22, clean[10] + " mail me at joe@example.org now " + clean[11] * 400, "en", "a", 9), (23, clean[0], "en", "a", 1), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(rows)], schema)


def test_stages_on_odd_documents(spark, sf_dir):
    """Every stage keeps columns and their values, and what is defined for nulls, ties and repeats holds."""
    docs = odd_documents(spark)
    before = {r["email"]: r.asDict() for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        found = {r["email"]: r.asDict() for r in out.collect()}
        changed = {"text", "n_chars"} if name == "personal data" else set()
        assert all(v == before[e][c] for e, r in found.items() for c, v in r.items() if c not in changed)
        kept[name] = sorted(int(e.removeprefix("email")) for e in found)
        if name == "personal data":
            assert found["email13"]["text"] == before["email13"]["text"].replace("joe@example.org", "[EMAIL]") and found["email13"]["n_chars"] == len(found["email13"]["text"])
            assert found["email11"]["text"] is None and found["email12"]["text"] == ""
    assert kept["personal data"] == list(range(16)) and kept["benchmark leaks"] == list(range(16))
    assert {0, 1, 2, 3, 4, 5} <= set(kept["quality rules"]) and not {11, 12} & set(kept["quality rules"])
    assert 14 not in kept["near duplicates"] and 0 in kept["near duplicates"] and {6, 7, 15} <= set(kept["near duplicates"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == 16 and sum(r["doc_id"] is None for r in last) == 3
