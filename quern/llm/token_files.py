"""Token ids in binary shards: one id array per shard, document boundaries as Elias-Fano codes.

Layout of a shard, all numbers little-endian:

    ids of all its documents, 2 or 4 bytes each
    Elias-Fano code of the n + 1 document boundaries (in ids), from 0, with its directory for select
    the same of the document ids, less the smallest; the first documents may have none
    trailer: id width, number of null document ids, smallest document id, place of the codes, magic

Shards are written in ascending order of document id, nulls first. Each task names its files anew and reports them in a
manifest that is written when the task ends, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.elias_fano import EliasFano
from quern.llm.workers import no_cycles, tasks_for
from quern.sources.files import open_output, open_random
from quern.workspace import fresh_path, materialize

MAGIC = b"QRNTOK01"
TRAILER = struct.Struct("<BQqQ8s")
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"
MEMORY_WORDS = 400_000
# The pattern by which the tokenizer file cuts words, and the same within Latin-1, for lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
LATIN_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+")
ROWS_AT_ONCE = 256
SHARD_IDS = 1 << 26
SHARD_DOCS = 1 << 18
BATCH_BYTES = 8 << 20
SELECT_AT_ONCE = 256
SHARDS_PER_TASK = 4


class WordEncoder:
    """Ids of texts as bytes.

    A tokenizer that lower-cases, drops white space and cuts by WORD_PATTERN encodes each cut by itself, ending it with a piece
    marked as a word's end. Texts within Latin-1, where normalization changes nothing but case, are cut here;
    each distinct cut goes through the tokenizer once, many in one call, and the marks show where each ends. Cuts seen before come
    from a bounded memory of two generations: when the younger one is full it becomes the older, and what is used
    again moves on to the next. All other texts, all texts of other tokenizers, and batches with words that the tokenizer does not end as expected
    are encoded whole.
    """

    def __init__(self, tokenizer_path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(tokenizer_path), dtype
        spec = json.loads(self.tokenizer.to_str())
        cutter = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.cuts_words = cutter[0].get("pattern") == {"Regex": WORD_PATTERN} and bool(suffix) and normal == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if self.cuts_words:
            for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.is_end[i] = piece.endswith(suffix)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cuts: set[str]) -> bool:
        """Whether the tokenizer cuts these words as expected; their ids are known then."""
        known, older = self.known, self.older
        again = cuts & older.keys()
        known.update(zip(again, map(older.get, again)))
        new = list(cuts - again)
        if not new:
            return True
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = ((np.flatnonzero(self.is_end[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) != len(new):
            return False
        coded = ids.tobytes()
        known.update(zip(new, [coded[a:b] for a, b in zip([0, *ends], ends)]))
        return True

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY_WORDS:
            self.known, self.older = {}, self.known
        get, find = self.known.get, LATIN_WORDS.findall
        coded, rows, cut, whole = [b""] * len(texts), [], [], []
        for row, text in enumerate(texts):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                whole.append(row)
                continue
            if not self.cuts_words or "<|" in text and self.added.search(text):
                whole.append(row)
                continue
            rows.append(row)
            cut.append(find(text.lower()))
        if not self._learn(set().union(*cut).difference(self.known)):
            return self._whole(texts)
        for row, words in zip(rows, cut):
            coded[row] = b"".join(map(get, words))
        for row, ids in zip(whole, self._whole([texts[row] for row in whole])):
            coded[row] = ids
        return coded


@lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str, dtype: str) -> WordEncoder:
    """One per tokenizer and worker."""
    return WordEncoder(tokenizer_path, dtype)


class ShardWriter:
    def __init__(self, folder: str, part: int, dtype: str):
        self.folder, self.part, self.width, self.seq = folder, part, np.dtype(dtype).itemsize, 0
        self._begin()

    def _begin(self) -> None:
        self.out, self.ends, self.doc_ids, self.nulls, self.total = None, array("Q", [0]), array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        if self.out is None:
            self.path = f"{self.folder}/part-{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}.qtok"
            self.out = open_output(self.path)
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)
        if self.total >= SHARD_IDS or len(self.ends) > SHARD_DOCS:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.out is None:
            return
        least = self.doc_ids[0] if self.doc_ids else 0
        ids = np.array(self.doc_ids, dtype=np.int64).view(np.uint64) - np.uint64(least % (1 << 64))
        self.out.write(EliasFano.encode(np.array(self.ends, dtype=np.uint64)).to_bytes())
        self.out.write(EliasFano.encode(ids).to_bytes())
        self.out.write(TRAILER.pack(self.width, self.nulls, least, self.total * self.width, MAGIC))
        self.out.close()
        row = {"part": self.part, "seq": self.seq, "path": self.path, "n_docs": len(self.ends) - 1, "n_ids": self.total}
        self.seq += 1
        self._begin()
        yield row


def read_shard(path: str) -> Iterator[tuple[int | None, int, bytes]]:
    """(document id, place of its first id in the shard, ids as unsigned 32-bit bytes) of every document.

    Boundaries and document ids stay coded; select gives those of SELECT_AT_ONCE documents at a time.
    """
    with open_random(path) as file:
        size = file.size()
        file.seek(size - TRAILER.size)
        width, nulls, least, codes_at, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        file.seek(codes_at)
        codes = file.read(size - TRAILER.size - codes_at)
        ends, at = EliasFano.from_bytes(codes)
        doc_ids, _ = EliasFano.from_bytes(codes, at)
        n_docs = max(0, ends.n - 1)
        if n_docs and ends.select(n_docs) * width != codes_at:
            raise ValueError(f"{path}: boundaries end at {ends.select(n_docs)} ids, the file holds {codes_at // width}")
        file.seek(0)
        for at in range(0, n_docs, SELECT_AT_ONCE):
            upto = min(at + SELECT_AT_ONCE, n_docs)
            bounds = ends.select_range(at, upto + 1 - at).tolist()
            named = max(at, nulls)
            names = [None] * (min(named, upto) - at) + [d + least for d in doc_ids.select_range(named - nulls, max(0, upto - named)).tolist()]
            for name, start, end in zip(names, bounds, bounds[1:]):
                yield name, start, np.frombuffer(file.read((end - start) * width), dtype=f"<u{width}").astype("<u4").tobytes()


def read_document(path: str, i: int) -> bytes:
    """The ids of one document, as unsigned 32-bit bytes: two selects and one read."""
    with open_random(path) as file:
        size = file.size()
        file.seek(size - TRAILER.size)
        width, _, _, codes_at, _ = TRAILER.unpack(file.read(TRAILER.size))
        file.seek(codes_at)
        ends, _ = EliasFano.from_bytes(file.read(size - TRAILER.size - codes_at))
        start, end = ends.select_range(i, 2).tolist()
        file.seek(start * width)
        return np.frombuffer(file.read((end - start) * width), dtype=f"<u{width}").astype("<u4").tobytes()


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 2) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending order of id. Returns the manifest, with ``base``: ids in all shards before.

    Null texts are empty; rows with equal ids stand in order of their texts; id_bytes 2 is for vocabularies up to 65,536.
    """
    if id_bytes not in (2, 4):
        raise ValueError("id_bytes is 2 or 4")
    dtype = f"<u{id_bytes}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, dtype)
        end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
        writer = ShardWriter(folder, TaskContext.get().partitionId(), dtype)
        rows: list[dict] = []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                with no_cycles():
                    coded = encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                for doc_id, ids in zip(batch.column(0).to_pylist(), coded):
                    rows += writer.add(doc_id, ids + end)
        rows += writer.close()
        names = [field.split()[0] for field in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one small row per shard


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document in the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            names, starts, ids = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for name, start, ids in read_shard(path):
                    rows.append((name, base + start, ids))
                    held += len(ids)
                    if held >= BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)

    return manifest.select("path", "base").repartition(tasks_for(manifest, SHARDS_PER_TASK)).mapInArrow(read, ROWS)


def shard_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "token-shards")
