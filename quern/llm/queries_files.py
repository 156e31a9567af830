"""op10: token shards; op5: web archives."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import token_files, warc
from quern.session import table

END_ID = 2


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_shards(table(spark, sf_dir, "documents"), token_files.shard_folder(spark), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_token_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


QUERIES = {"op5_warc": op5_warc, "op10_token_files": op10_token_files}

# Twenty bytes in hexadecimal, five digits of them at a time, are four of base32 each.
_BASE32 = "array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT, 1)), '')"

ORACLES = {
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages), r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL AS error FROM r""",
}
