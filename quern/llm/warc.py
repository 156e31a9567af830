"""Web archives (WARC 1.1) under Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page id is a
response; the others are revisits that name it. Reading: the dictionary comes from the archive itself, each frame is one
record, and version line, required fields, lengths, digests and the closing line breaks are checked; what is wrong is
told in ``error``. Both ways stream: a task holds one record and, when writing, one compressed frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.workers import tasks_for
from quern.sources.files import open_input, open_output
from quern.workspace import fresh_path, materialize

SKIPPABLE = 0x184D2A50  # first of sixteen magic numbers
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")
ARCHIVE_BYTES = 32 << 20
ARCHIVES_PER_TASK = 16
READ_BYTES = 1 << 16
BATCH_BYTES = 8 << 20
ROWS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string, archive string, position long"
_RECORD_ID = re.compile(r"<urn:quern:page:(-?\d+)>$")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. The payload is left out of a revisit, whose HTTP head still tells its length."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:quern:page:{page_id}>" if page_id is not None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}').urn}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(chr(c) for c in range(33, 127) if c != 37))))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:quern:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, list[str]]:
    """(fields by lower-case name, block, what is wrong)."""
    wrong: list[str] = []
    top, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return {}, b"", ["the header does not end"]
    lines = top.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        wrong.append(f"version line {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            wrong.append(f"field {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    wrong += [f"no {name}" for name in REQUIRED if not fields.get(name)]
    length = fields.get("content-length", "")
    if not length.isdecimal():
        wrong.append("content-length is no number")
        return fields, b"", wrong
    block, tail = rest[: int(length)], rest[int(length) :]
    if len(block) != int(length) or tail != END:
        wrong.append(f"content-length {length}, but the frame holds {len(rest) - len(END)}")
    stated = fields.get("warc-block-digest")
    if stated and stated != f"sha1:{base32_sha1(block)}":
        wrong.append("block digest differs")
    return fields, block, wrong


class FrameReader:
    """Frames of an archive, one after the other, decoded with the dictionary that it begins with."""

    def __init__(self, stream):
        self.stream, self.held, self.taken = stream, b"", 0
        self.dictionary: zstandard.ZstdCompressionDict | None = None

    def _fill(self, size: int) -> bool:
        while len(self.held) < size:
            more = self.stream.read(READ_BYTES)
            if not more:
                return False
            self.held += more
        return True

    def _take(self, size: int) -> bytes:
        part, self.held = self.held[:size], self.held[size:]
        self.taken += len(part)
        return part

    def __iter__(self) -> Iterator[tuple[int, bytes, str | None]]:
        """(place of the frame, its content, what is wrong)."""
        while self._fill(1):
            at = self.taken
            if not self._fill(8):
                yield at, b"", "the archive ends within a frame"
                return
            magic, size = struct.unpack("<II", self.held[:8])
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                if not self._fill(8 + size):
                    yield at, b"", "the archive ends within a skippable frame"
                    return
                self._take(8)
                content = self._take(size)
                if magic == DICTIONARY_MAGIC and at == 0 and content:
                    if content[:4] == FRAME_MAGIC:
                        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                    self.dictionary = zstandard.ZstdCompressionDict(content)
                continue
            options = {"dict_data": self.dictionary} if self.dictionary is not None else {}
            decoder, parts = zstandard.ZstdDecompressor(**options).decompressobj(), []
            try:
                while not decoder.eof:
                    if not self._fill(1):
                        yield at, b"", "the archive ends within a frame"
                        return
                    chunk = self._take(len(self.held))
                    parts.append(decoder.decompress(chunk))
                rest = decoder.unused_data
                self.held, self.taken = rest + self.held, self.taken - len(rest)
            except zstandard.ZstdError as error:
                yield at, b"", f"frame cannot be decoded: {error}"
                return
            yield at, b"".join(parts), None


def train_dictionary(pages: DataFrame, html_col: str, sample_rows: int = 256, sample_chars: int = 16384, size: int = 32768) -> bytes:
    """A dictionary fitted on a bounded sample: the first sample_chars of about sample_rows pages whose hashes are below a threshold, set by the number of pages.

    Four times sample_rows at most come to the driver. Empty if they are too few.
    """
    share = min(1.0, sample_rows / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64(html_col), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = pages.where((F.length(html_col) > 0) & drawn).select(F.substring(html_col, 1, sample_chars).alias("h")).limit(4 * sample_rows).collect()
    try:
        return zstandard.train_dictionary(size, sorted(r["h"].encode("utf-8", "surrogatepass") for r in rows)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): html null counts as empty, refers_to is null for responses.

    Rows that repeat the smallest id of their payload are all responses; a null id is larger than any other.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digested = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long_enough = F.octet_length("html") >= min_revisit_bytes
    shared = digested.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    shared = materialize(shared.select("digest", "first_id"), "warc-shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return digested.join(shared, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    """Write one record per row of mark_revisits(). Returns the manifest (path, n_records), written when all tasks are done."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        encoder = zstandard.ZstdCompressor(level=level, **options)
        out, path, done, size, count = None, "", [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    out, size, count = open_output(path), 0, 0
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = encoder.compress(record_bytes(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers_to.as_py()))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])

    return materialize(marked.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, n_records long"), "warc-manifest")


def _page_of(record_id: str | None) -> int | None:
    found = _RECORD_ID.search(record_id or "")
    return int(found[1]) if found else None


def read_records(path: str, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of ROWS for one archive. payload_bytes and payload of revisits are null: their payload stands elsewhere."""
    with open_input(path) as stream:
        for position, data, fault in FrameReader(stream):
            fields, block, wrong = parse_record(data) if fault is None else ({}, b"", [fault])
            kind = fields.get("warc-type")
            payload: bytes | None = None
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response" and fault is None:
                _, gap, payload = block.partition(b"\r\n\r\n")
                if not gap:
                    wrong.append("the HTTP head does not end")
                found = base32_sha1(payload)
                if digest not in (None, found):
                    wrong.append("payload digest differs")
                digest = found
            elif kind == "revisit" and not fields.get("warc-refers-to"):
                wrong.append("a revisit that names no record")
            url = fields.get("warc-target-uri")
            yield _page_of(fields.get("warc-record-id")), None if url is None else unquote(url), kind, _page_of(fields.get("warc-refers-to")), None if payload is None else len(payload), digest, payload if with_payload else None, "; ".join(wrong) or None, path, position


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives that the manifest's column path names."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in ROWS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((),) * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in read_records(path, with_payload):
                    rows.append(row)
                    held += 200 + len(row[6] or b"")
                    if held >= BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)

    return manifest.select("path").repartition(tasks_for(manifest, ARCHIVES_PER_TASK)).mapInArrow(read, ROWS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records (a written table) with payload_bytes of revisits taken from the response they name; an error if there is none or its digest differs.

    The lengths of responses that revisits name are written first, so that a page that very many revisits name is not dealt to one task.
    """
    named = records.where("record_type = 'revisit' and refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    lengths = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    lengths = materialize(lengths.join(named, "page_id", "left_semi"), "warc-lengths")
    lengths = lengths.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "__bytes")
    joined = records.join(lengths, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    lost = F.when((F.col("record_type") == "revisit") & F.col("__page").isNull(), F.lit("the record named is missing or has another payload"))
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).withColumn("error", F.nullif(F.concat_ws("; ", "error", lost), F.lit(""))).drop("__page", "__digest", "__bytes")


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) as archives and return what reading them gives, revisits resolved."""
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    manifest = write_archives(mark_revisits(pages, min_revisit_bytes=min_revisit_bytes), folder, train_dictionary(pages, "html"))
    return resolve_revisits(materialize(read_archives(manifest, with_payload), "warc-records"))
