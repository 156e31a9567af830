import hashlib
import io
import random
import struct
import zlib
from base64 import b32encode

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import queries_files, token_files, warc
from quern.llm.elias_fano import EliasFano
from quern.workspace import fresh_path
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "Hello  world.\n\nIt's", "İ. İSTANBUL. é. é.", "x <|endoftext|> y<|endoftext|>z.", "\x01 a\x1cb\x85c　d", "ΑΣ. ΣΑΣ, σς", "日本語。テスト!🎉", "1234.5, 6! don't I'll we've.", "a" * 50000, "ﬁ ß ẞ. µ ª º ²³¹¼½¾"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50)))
def test_elias_fano_round_trip(values):
    values = np.array(sorted(values), dtype=np.uint64)
    coded, end = EliasFano.from_bytes(b"xx" + EliasFano.encode(values).to_bytes(), 2)
    assert coded.decode().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()
    assert all(coded.select_range(i, j).tolist() == values[i : i + j].tolist() for i, j in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values), 0)))
    assert end == len(EliasFano.encode(values).to_bytes()) + 2


def test_elias_fano_is_small_and_strict():
    values = np.cumsum(np.random.default_rng(1).integers(0, 400, 50000)).astype(np.uint64)
    assert len(EliasFano.encode(values).to_bytes()) * 8 < 50000 * (2 + np.log2(200) + 1.5)
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))


def test_select_over_many_blocks():
    values = np.cumsum(np.random.default_rng(2).choice([0, 1, 5000], 20000)).astype(np.uint64)
    coded, _ = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert [coded.select(i) for i in range(0, 20000, 997)] == values[::997].tolist() and coded.select_range(255, 258).tolist() == values[255:513].tolist()
    with pytest.raises(IndexError):
        coded.select(20000)


def test_readers_select(spark, monkeypatch):
    """Neither reader decodes a shard's codes as a whole."""
    docs = spark.createDataFrame([(i - 300, f"text number {i}") for i in range(600)] + [(None, "none")] * 300, "doc_id long, text string").coalesce(1)
    path = token_files.write_token_shards(docs, fresh_path(spark, "t"), WORDS, 2).first()["path"]
    monkeypatch.setattr(EliasFano, "decode", None)
    rows = list(token_files.read_shard(path))
    assert [r[0] for r in rows] == [None] * 300 + list(range(-300, 300))
    assert all(token_files.read_document(path, i) == rows[i][2] for i in (0, 299, 300, 899))


def test_other_cuts_fall_back_to_whole_texts():
    coder = token_files.WordEncoder(WORDS, "<u2")
    want = coder.encode_batch(["one two", "three"])
    coder.known, coder.is_end = {}, coder.is_end & False
    assert coder.encode_batch(["one two", "three"]) == want


def test_word_encoder_equals_the_library():
    pick = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(chr(pick.randint(1, 255)) for _ in range(60)) for _ in range(2000)] + ["".join(pick.choice("aB'sstremvld. 12éΣ́") for _ in range(40)) for _ in range(1000)]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    coder = token_files.WordEncoder(WORDS, "<u2")
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode_batch(texts)] == want
    coder.known, coder.older = {}, coder.known  # the older generation
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode_batch(texts)] == want


def test_token_files_hold_every_document(spark):
    rows = [(i * 3 % 101, t, "clash") for i, t in enumerate(ODD * 3)] + [(None, "no id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = token_files.write_token_shards(docs, fresh_path(spark, "t"), WORDS, 2)
    got = sorted(token_files.read_token_shards(manifest).collect(), key=lambda r: r["start"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    library, at = Tokenizer.from_file(WORDS), 0
    for row, (doc, text, _) in zip(got, ordered, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        at += len(ids)


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_shards(token_files.write_token_shards(docs, fresh_path(spark, "t"), WORDS, 2)).collect() == []


def test_shards_roll(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SHARD_IDS", 5)
    writer = token_files.ShardWriter(str(tmp_path), 0, "<u2")
    rows = [r for i in range(10) for r in writer.add(i, b"\1\0\2\0")] + list(writer.close())
    assert [r["n_docs"] for r in rows] == [3, 3, 3, 1]
    assert [list(token_files.read_shard(r["path"]))[0][0] for r in rows] == [0, 3, 6, 9]


def test_op10_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries_files.op10_token_files(spark, sf_dir).collect()}
    library, at = Tokenizer.from_file(WORDS), 0
    assert rows.keys() == texts.keys()
    for doc in sorted(texts):
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def digest(html):
    return b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [(5, "http://a/x?y=ü&z=%20 1\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (7, "u", ""), (11, "v", "z" * 200_000), (None, "w", "<p>é</p>"), (3, "q", "WARC/1.1\r\n\r\n\r\nx"), (2, "r", "<p>é</p>")]


def archived(spark, rows, **options):
    return warc.archive_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2), **options).collect()


def test_archives_give_every_page_back(spark):
    rows = archived(spark, PAGES)
    assert all(r["error"] is None for r in rows)
    want = sorted([(i, len((h or "").encode()), digest(h), *(("response", None) if i in (2, 7, 11, 3) else ("revisit", 7 if i == 9 else 2))) for i, _, h in PAGES], key=str)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows], key=str) == want
    held = {(r["page_id"], r["url"]): r["payload"] for r in rows if r["record_type"] == "response"}
    assert bytes(held[(11, "v")]) == b"z" * 200_000 and bytes(held[(2, None)]) == "<p>é</p>".encode()
    assert {r["url"] for r in rows} == {u for _, u, _ in PAGES}


def test_small_payloads_are_all_responses(spark):
    assert {r["page_id"] for r in archived(spark, PAGES, min_revisit_bytes=10) if r["record_type"] == "response"} == {5, 2, 9, 7, 11, None, 3}
    assert archived(spark, []) == []


def test_op5_matches_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[digest(p["html"])] = min(p["page_id"], first.get(digest(p["html"]), p["page_id"]))
    want = sorted((p["page_id"], len((p["html"] or "").encode()), digest(p["html"]), "response" if first[digest(p["html"])] == p["page_id"] else "revisit") for p in pages)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in queries_files.op5_warc(spark, sf_dir).collect()) == want


def frames(*records, dictionary=None):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    coder = zstandard.ZstdCompressor(**options)
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(coder.compress(r) for r in records)


def test_reader_takes_the_dictionary_plain_or_compressed():
    samples = [f"<html><body>page {i} says {i * i} to all readers of page {i}</body></html>".encode() * 3 for i in range(400)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    record = warc.record_bytes(1, "http://x", samples[7], None)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    for head in (dictionary, packed):
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(head)) + head + frames(record, record, dictionary=dictionary)[8 + len(dictionary) :]
        data += struct.pack("<II", warc.SKIPPABLE, 3) + b"abc"
        assert [(d, e) for _, d, e in warc.FrameReader(io.BytesIO(data))] == [(record, None)] * 2


def test_reader_tells_what_is_wrong(tmp_path):
    good = warc.record_bytes(1, "http://x", b"payload", None)
    bad = {
        "version line": good.replace(b"WARC/1.1", b"WARK/1.1"), "no warc-date": good.replace(b"WARC-Date: ", b"X-Date: "), "content-length": good[:-6] + good[-4:],
        "payload digest": good.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), "block digest": good.replace(b"payload\r\n", b"payloaD\r\n"), "no number": good.replace(b"Content-Length: 9", b"Content-Length: q9"),
        "names no record": warc.record_bytes(1, "http://x", b"payload", 4).replace(b"WARC-Refers-To: ", b"X: "),
    }
    for fault, record in bad.items():
        if fault == "no number":
            record = good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: q", 1)
        path = tmp_path / "a.warc.zst"
        path.write_bytes(frames(record, good))
        first, second = warc.read_records(str(path))
        assert fault in first[7] and second[7] is None, (fault, first[7])
    path.write_bytes(frames(good)[:-5])
    assert "ends within a frame" in list(warc.read_records(str(path)))[0][7]
