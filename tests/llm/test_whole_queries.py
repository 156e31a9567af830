"""Registered queries without SQL on small tables, their columns held against brute force."""

import random
import zlib

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from quern.llm import registry
from test_simhash import brute_components
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """documents with near copies, odd texts, nulls; pages whose article is known."""
    where, draw = tmp_path_factory.mktemp("tables"), random.Random(12)
    words = ["".join(draw.choices("abcdeéüß日", k=draw.randint(1, 6))) for _ in range(200)]
    rows, texts = [], [None, "", " \n\t", "one", "ONE", "x" * 9000, "日本語" * 700, "tab\tand\nline", " ▁ lead", "trail  "]
    for _ in range(12):
        base = draw.choices(words, k=draw.randint(3, 200))
        for _ in range(draw.randint(1, 4)):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(["Changed", copy[0]])
            texts.append(draw.choice([" ", "  ", "\n"]).join(copy))
    rows = [(i * 3, t, draw.choice(["en", None]), "s", 1) for i, t in enumerate(texts)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(where / "documents.parquet")
    article = [" ".join(draw.choices(words, k=40)) + "." for _ in range(4)]
    body = "".join(f"<p>{p}</p>" for p in article)
    menu = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[:8]) + "</ul></nav>"
    pages = [f"<html><body>{menu}<article>{body}</article><footer>Copyright</footer><script>var x = '<p>no</p>';</script></body></html>", None, "", body]
    pd.DataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(pages)], columns=["page_id", "url", "html"]).to_parquet(where / "pages.parquet")
    return str(where), rows, "\n".join(article), len(pages)


def test_op1(spark, folder):
    where, rows, *_ = folder
    out = registry.queries()["op1_simhash"](spark, where).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out), key=str) == brute_components([(d, t) for d, t, *_ in rows])


def test_op7(spark, folder):
    where, rows, *_ = folder
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in registry.queries()["op7_pieces"](spark, where).collect()}
    assert {d: r["ids"] for d, r in out.items()} == {d: library.encode(t or "") for d, t, *_ in rows}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())
    assert all(out[d]["decoded_equal"] == ("▁" not in (t or "")) for d, t, *_ in rows)


def test_op8(spark, folder):
    where, _, article, n = folder
    out = {r["page_id"]: r for r in registry.queries()["op8_html"](spark, where).collect()}
    assert [out[i]["text"] for i in range(n)] == [article, "", "", article] and all(r["n_chars"] == len(r["text"]) and r["url"] == f"https://x.example/{i}" for i, r in out.items())


def test_op10(spark, folder):
    where, rows, *_ = folder
    coder, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text, *_ in sorted(rows):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    out = registry.queries()["op10_token_files"](spark, where).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
