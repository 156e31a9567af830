import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from quern.llm import simhash
from quern.llm.components import connected_components
from quern.llm.golay import near_indices

DOCS = "doc_id long, text string, fp string, component_id long"


def brute_fingerprint(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=2, n=3):
    prints = [brute_fingerprint(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            label[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], DOCS)
    out = simhash.near_duplicate_classes(frame, **options).collect()
    return sorted(((r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in out), key=str)


def sample_rows():
    pick = random.Random(4)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 5))) for _ in range(300)]
    rows, i = [], 0
    for _ in range(25):
        base = [pick.choice(words) for _ in range(pick.randint(1, 400))]
        for _ in range(pick.randint(1, 6)):
            copy = list(base)
            if pick.random() < 0.7:
                copy[pick.randrange(len(copy))] = "Changed"
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one two"), (None, "alone in its class here"), (1006, "a b c"), (1006, "a b c"), (1007, "w " * 30000), (1008, "ÀÉ à É x")]


def test_classes_match_brute_force(spark):
    rows = sample_rows() + EDGES
    assert found(spark, rows) == brute_components(rows)


def test_crowded_buckets_take_the_exact_way(spark):
    rows = sample_rows()
    assert found(spark, rows, bucket_limit=1) == brute_components(rows)


@pytest.mark.parametrize("distance", [1, 3])
def test_other_distances(spark, distance):
    rows = sample_rows()
    assert found(spark, rows, max_distance=distance) == brute_components(rows, distance)
    assert found(spark, rows, max_distance=distance, bucket_limit=1) == brute_components(rows, distance)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_links_within_distance_share_a_key():
    pick = np.random.default_rng(1)
    values = pick.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for distance in (2, 3, 4):
        for flips in range(distance + 1):
            other = values.copy()
            for i in range(len(other)):
                for b in pick.choice(64, flips, replace=False):
                    other[i] ^= np.uint64(1) << np.uint64(b)
            keys = [{}, {}]
            for held, part in zip(keys, (values, other)):
                for row, key in zip(*simhash.golay_keys(part, distance)):
                    held.setdefault(int(row), set()).add(int(key))
            assert all(keys[0][i] & keys[1][i] for i in range(len(values)))


def test_golay_neighbours_share_a_name():
    words = np.random.default_rng(2).integers(0, 1 << 23, 3000)
    names = {}
    for row, index in zip(*near_indices(words)):
        names.setdefault(int(row), set()).add(int(index))
    for bit in range(23):
        for row, index in zip(*near_indices(words ^ (1 << bit))):
            names.setdefault((bit, int(row)), set()).add(int(index))
        assert all(names[i] & names[(bit, i)] for i in range(len(words)))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {out[i] for i in range(301)} == {0} and {out[1000 + i] for i in range(200)} == {1000}


def test_one_document_of_each_class_stays(spark):
    text = "the same words stand here in each of these texts " * 5
    rows = [(3, text, "k", 1), (5, text, "k", 2), (None, text, "k", 3), (9, "something else entirely is written in this one", "k", 4), (9, text, "k", 5)]
    kept = simhash.keep_one_per_class(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in kept if r["doc_id"] is not None) == [(False, 3, 1), (False, 9, 4), (False, 9, 5)]
    assert [r["component_id"] for r in kept if r["doc_id"] is None] == [3]
