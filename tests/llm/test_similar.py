import random
from itertools import combinations

import corpus_pipeline
from quern.llm import similar, simhash

DOCS = "doc_id long, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label))


def sample_rows():
    pick = random.Random(11)
    vocabulary = ["".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    line = [pick.choice(vocabulary) for _ in range(25)]
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b  c d e", "a b c d e f", "w " * 300]
    for _ in range(20):
        base = [pick.choice(vocabulary) for _ in range(pick.choice((5, 9, 20, 60, 150, 300)))]
        for _ in range(pick.randint(1, 12)):
            copy = list(base)
            for _ in range(pick.randint(0, 6)):
                at = pick.randrange(len(copy))
                copy[at : at + pick.randint(0, 1)] = [pick.choice(vocabulary)] * pick.randint(0, 2)
            texts.append(" ".join(copy + line * (pick.random() < 0.3)))
    return list(enumerate(texts, 1))


def test_one_of_each_class_as_by_brute_force(spark):
    rows = sample_rows()
    kept = similar.keep_one_of_similar(spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS).repartition(3)).collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(rows)


def test_the_stage_drops_texts_that_are_similar_by_a_few_words(spark):
    pick = random.Random(3)
    base = ["".join(pick.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    near, far = list(base), list(base)
    near[40] = near[90] = "changed"
    for at in range(10, 130, 15):
        far[at] = "changed"
    rows = [(1, " ".join(base), "x"), (2, " ".join(near), "x"), (3, " ".join(far), "x")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()) == [1, 3]


def test_the_stage_links_fingerprints(spark):
    """Texts whose fingerprints agree and whose sets of shingles hardly do, and all that similarity alone connects."""
    rows = [(1, "w " * 300 + "it ends with these words here", "x"), (2, "w " * 300 + "and so does another one of them", "x"), (3, "w " * 5 + "this one has other shingles than the two and is left", "x")]
    prints = {r["id"]: r["fp"] for r in simhash.fingerprints(spark.createDataFrame(rows, DOCS), shingle_words=5).collect()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 < (prints[1] ^ prints[3]).bit_count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()) == [1, 3]
    rows = sample_rows()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in kept) == brute_kept(rows)


def test_repeated_and_missing_ids(spark):
    text = "the same words stand here in each of these texts " * 5
    rows = [(3, text, "1"), (5, text, "2"), (None, text, "3"), (9, "something else entirely is written in this one", "4"), (9, text, "5")]
    kept = similar.keep_one_of_similar(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["lang"] for r in kept) == ["1", "3", "4", "5"]
    assert similar.keep_one_of_similar(spark.createDataFrame([], DOCS)).collect() == []
