"""op12: the manifest of documents with proofs, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.merkle import dataset_manifest, group_key, leaf_digest, prove
from quern.session import table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id's checksum TAMPERED divides claim one character more than they have."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    leaves = docs.select(group_key(F.col("lang")).alias("grp"), "doc_id", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.when(hit, altered).alias("claimed"))
    return prove(dataset_manifest(leaves, "doc_id"), ["doc_id"])


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Levels of trees over leaves (grp, pos, digest, n): one recursion per level, two nodes at a time."""
    return f"""{name} AS (SELECT grp, 0 AS level, pos, digest, n FROM {leaves} UNION ALL
    SELECT grp, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 2, n)"""


def _sql_walk(name: str, start: str, tree: str) -> str:
    """Every leaf's way up: its place, what its claim folds to, and the siblings so far."""
    return f"""{name} AS (SELECT rid, grp, 0 AS level, pos, n, folded, siblings FROM {start} UNION ALL
    SELECT w.rid, w.grp, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN s.digest IS NULL THEN w.folded WHEN w.pos % 2 = 0 THEN w.folded || s.digest ELSE s.digest || w.folded END),
        w.siblings || coalesce(s.digest, '') FROM {name} w LEFT JOIN {tree} s ON s.grp = w.grp AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""


_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"

ORACLE = f"""
WITH RECURSIVE leafed AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS grp, {_sql_leaf("n_chars")} AS digest,
        CASE WHEN coalesce({_CRC} % {TAMPERED} = 0, false) THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS folded FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leafed),
{_sql_tree("inner_tree", "placed")},
subs AS (SELECT '' AS grp, grp AS member, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
{_sql_tree("outer_tree", "subs")},
begin_inner AS (SELECT rid, grp, pos, n, folded, '' AS siblings FROM placed),
{_sql_walk("inner_walk", "begin_inner", "inner_tree")},
begin_outer AS (SELECT w.rid, '' AS grp, s.pos, s.n, w.folded, w.siblings FROM inner_walk w JOIN subs s ON s.member = w.grp WHERE w.n = 1),
{_sql_walk("outer_walk", "begin_outer", "outer_tree")}
SELECT doc_id, p.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
FROM outer_walk w JOIN placed p ON p.rid = w.rid JOIN subs s ON s.member = p.grp JOIN outer_tree r ON r.n = 1 WHERE w.n = 1
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": ORACLE}
