"""op12: stacks against whole trees, manifests and proofs against hashing by hand, edges."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quern.llm import merkle
from quern.llm.merkle_stack import MountainRange, fold, path_through, sibling_levels


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_levels(digests, fanout):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute_proof(levels, place, fanout):
    found = []
    for level in levels[:-1]:
        begin = place // fanout * fanout
        found.append(("".join(level[begin:place]), "".join(level[place + 1 : begin + fanout])))
        place //= fanout
    return found


def brute_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 120), st.integers(2, 5), st.randoms(use_true_random=False))
def test_stretches_meet_in_the_whole_tree(n, fanout, draw):
    """However leaves are cut into stretches, their peaks and nodes are the tree's, each node once."""
    digests = [h(str(i)) for i in range(n)]
    levels = brute_levels(digests, fanout)
    cuts = [0, *sorted(draw.sample(range(1, n), min(n - 1, draw.randint(0, 6)))), n]
    nodes, peaks = [], []
    for a, b in zip(cuts, cuts[1:]):
        stack = MountainRange(n, fanout)
        for i in range(a, b):
            stack.push(0, i, digests[i].encode())
        nodes += stack.nodes
        peaks += stack.finish()
    whole = MountainRange(n, fanout)
    for level, place, digest in sorted(peaks, key=lambda p: p[1] * fanout ** p[0]):
        whole.push(level, place, digest)
    nodes += whole.nodes
    assert whole.finish() == [(len(levels) - 1, 0, levels[-1][0].encode())]
    assert sorted(nodes) == sorted((k, i, d.encode()) for k, level in enumerate(levels) if k for i, d in enumerate(level))


def test_gaps_are_noticed():
    stack = MountainRange(8, 4)
    stack.push(0, 0, b"a")
    with pytest.raises(ValueError):
        stack.push(0, 2, b"b")


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 60), st.integers(2, 4))
def test_siblings(n, fanout):
    digests = [h(str(i)) for i in range(n)]
    levels = brute_levels(digests, fanout)
    found, top = sibling_levels([d.encode() for d in digests], fanout, len(levels) - 1)
    assert top == [levels[-1][0].encode()]
    for i in range(n):
        path = brute_proof(levels, i, fanout)
        assert path_through(found, i, fanout) == [(a.encode(), b.encode()) for a, b in path]
        assert fold(digests[i].encode(), [(a.encode(), b.encode()) for a, b in path]) == levels[-1][0].encode()


def brute_manifest(rows, fanout, altered):
    """rows (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, brute_leaf(*row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_levels([leaf for *_, leaf, _ in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in order}
    outer = brute_levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for at, g in enumerate(order):
        for i, (*_, leaf, row) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            path = brute_proof(trees[g], i, fanout) + brute_proof(outer, at, fanout)
            claimed = brute_leaf(*row[:3], None if row[3] is None else row[3] + 1, row[4]) if altered(row[0]) else leaf
            for left, right in path:
                claimed = h(left, claimed, right)
            out.append((row[0], leaf, trees[g][-1][0], outer[-1][0], h(*(a + b for a, b in path)), claimed, claimed == outer[-1][0]))
    return sorted(out, key=str)


def hit(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf string, claimed string, pos long, size long"


def found_manifest(docs, fanout):
    leaves = docs.select(merkle.group_key(F.col("lang")).alias("grp"), "doc_id", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))).alias("claimed"))
    manifest = merkle.dataset_manifest(leaves, "doc_id", fanout)
    return manifest, sorted((tuple(r) for r in merkle.prove(manifest, ["doc_id"]).collect()), key=str)


@pytest.mark.parametrize("fanout, block", [(2, 4), (3, 9), (2, 1024), (16, 8)])
def test_manifest(spark, monkeypatch, fanout, block):
    """Nulls in every column, repeated rows and ids, empty and long texts, one-row groups; small blocks make several bands and rounds."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    draw = random.Random(fanout)
    rows = [(i, draw.choice(["s", None]), draw.choice(["en", "en", "en", "fr", None, "", "é"]), draw.choice([i, None]), draw.choice(["", None, "x" * i, "é" * i])) for i in range(150)]
    rows += [(None, "s", "en", 1, "t"), (None, None, None, None, None), (None, None, None, None, None), (7, "s", "one", 3, "y" * 200000)]
    rows += [(40, "s", "en", 1, "same")] * 30 + [(41, None, "en", 2, "b"), (41, None, "en", 2, "a")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "g", "l", "c", 0, 0) for r in rows], SCHEMA).repartition(7)
    manifest, found = found_manifest(docs, fanout)
    assert found == brute_manifest(rows, fanout, hit)
    nodes = manifest.nodes().collect()
    langs = {r[2] for r in rows}
    sizes = [sum(r[2] == g for r in rows) for g in langs] + [len(langs)]
    assert len(nodes) == sum(len(level) for n in sizes for level in brute_levels(["x"] * n, fanout)[1:])
    assert manifest.subroots().count() == len(langs)


def test_one_row_and_none(spark):
    one = [(3, "s", None, 5, "t")]
    docs = spark.createDataFrame([(*r, "g", "l", "c", 0, 0) for r in one], SCHEMA)
    assert found_manifest(docs, 2)[1] == brute_manifest(one, 2, hit)
    manifest, found = found_manifest(docs.limit(0), 2)
    assert found == [] and manifest.root is None and manifest.nodes().count() == 0


def test_a_lost_row_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = spark.createDataFrame([(i, "s", "en", i, "t", "g", "l", "c", 0, 0) for i in range(50)], SCHEMA)
    manifest, _ = found_manifest(docs, 2)
    torn = merkle.Manifest(merkle.Tree(manifest.groups.leaves.where("pos <> 21"), manifest.groups.nodes, manifest.groups.tops, 2), manifest.top, manifest.root)
    with pytest.raises(Exception, match="does not lead to its node"):
        merkle.prove(torn, ["doc_id"]).collect()


def test_fanout_is_checked():
    with pytest.raises(ValueError):
        merkle.stride(1)
