"""Versioned tables, growing indexes and as-of joins against plain Python; failures, repeated batches and writers at once."""

import random
import threading

import pytest
from pyspark.sql import functions as F
from quern.operators import asof, retrieval
from quern.sources.manifests import ManifestLog
from quern.sources.segments import GrowingIndex
from quern.sources.versions import VersionedTable

ROW = "store string, rel_path string, version int, size long"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_versions_against_a_dictionary(spark, path):
    """Random upserts, deletions and compactions, nulls among the keys; every version stays as it was."""
    draw, table, model, seen = random.Random(1), VersionedTable(spark, path, ["store", "rel_path"], "version"), {}, {}
    for step in range(9):
        some = {(draw.choice(["a", "b", None]), draw.choice(["x", "y", "z", None])) for _ in range(4)}
        kind = "upsert" if step < 2 else draw.choice(["upsert", "upsert", "delete", "compact"])
        if kind == "compact":
            table.compact()
        elif kind == "delete":
            table.delete(spark.createDataFrame([(*k, 9, 9) for k in some], ROW))
            model = {k: v for k, v in model.items() if k not in some}
        else:
            new = [(*k, draw.randint(1, 3), draw.randint(0, 99)) for k in some for _ in range(2)]
            table.upsert(spark.createDataFrame(new, ROW))
            best = {}
            for *k, version, size in new:
                best[tuple(k)] = max(best.get(tuple(k), (version, size)), (version, size))
            model |= {k: v for k, v in best.items() if v[0] >= model.get(k, (0,))[0]}
        seen[table.log.latest()[0]] = sorted(((*k, *v) for k, v in model.items()), key=str)
        assert rows(table.read()) == sorted(((*k, *v) for k, v in model.items()), key=str)
    assert all(rows(table.read(version)) == found for version, found in seen.items())
    assert [v for v, _ in table.history()] == list(range(1, table.log.latest()[0] + 1))


def test_batches_count_once(spark, path):
    table = VersionedTable(spark, path, ["store"])
    write = table.writer("stream")
    write(spark.createDataFrame([("a", "p", 1, 1)], ROW), 0)
    write(spark.createDataFrame([("a", "p", 1, 2)], ROW), 1)
    write(spark.createDataFrame([("a", "p", 1, 3)], ROW), 1)
    assert rows(table.read()) == [("a", "p", 1, 2)] and table.log.latest()[0] == 2
    table.upsert(spark.createDataFrame([("a", "p", 1, 4)], ROW), "other", 0)
    table.compact()
    write(spark.createDataFrame([("a", "p", 1, 5)], ROW), 1)
    assert rows(table.read()) == [("a", "p", 1, 4)]


def test_a_change_that_fails_is_not_seen(spark, path, monkeypatch):
    """The first try writes its rows and dies before the commit; the second leaves one result, and the orphan goes with vacuum."""
    table = VersionedTable(spark, path, ["store"])
    table.upsert(spark.createDataFrame([("a", "p", 1, 1)], ROW), "s", 0)
    batch = spark.createDataFrame([("b", "p", 1, 2)], ROW)
    with monkeypatch.context() as patched:
        patched.setattr(ManifestLog, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(batch, "s", 1)
    assert rows(table.read()) == [("a", "p", 1, 1)]
    table.upsert(batch, "s", 1)
    assert rows(table.read()) == [("a", "p", 1, 1), ("b", "p", 1, 2)]
    assert len(table.vacuum(keep=5)) == 1 and rows(table.read()) == [("a", "p", 1, 1), ("b", "p", 1, 2)]


def test_old_versions_go(spark, path):
    table = VersionedTable(spark, path, ["store"])
    for i in range(4):
        table.upsert(spark.createDataFrame([("a", "p", 1, i)], ROW))
    table.compact()
    table.vacuum(keep=1)
    assert rows(table.read()) == [("a", "p", 1, 3)] and [k for _, k in table.history()] == ["compact"]
    with pytest.raises(Exception):
        table.read(2)


def test_a_stream_into_a_table(spark, path, tmp_path):
    """Started again from its checkpoint the stream adds what is new; without its checkpoint it comes to the same rows."""
    table = VersionedTable(spark, path, ["store", "rel_path"], "version")
    source = f"{tmp_path}/in"

    def run(checkpoint):
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(table.writer("in")).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", "p", 1, 1), ("b", "p", 2, 2)], ROW).coalesce(1).write.parquet(source)
    run("one")
    spark.createDataFrame([("a", "p", 2, 3), ("b", "p", 1, 4)], ROW).coalesce(1).write.mode("append").parquet(source)
    run("one")
    assert rows(table.read()) == [("a", "p", 2, 3), ("b", "p", 2, 2)] and table.log.latest()[0] == 2
    run("two")
    assert rows(table.read()) == [("a", "p", 2, 3), ("b", "p", 2, 2)] and table.log.latest()[0] == 2


def test_writers_at_once(spark, path):
    """Every number of the log is one writer's, and no change is lost."""
    tables = [VersionedTable(spark, path, ["store"]) for _ in range(4)]
    frames = [[spark.createDataFrame([(f"{i}-{j}", "p", 1, j)], ROW) for j in range(3)] for i in range(4)]
    threads = [threading.Thread(target=lambda t=t, fs=fs: [t.upsert(f) for f in fs]) for t, fs in zip(tables, frames)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert tables[0].log.latest()[0] == 12 and tables[0].read().count() == 12


def test_compaction_beside_an_upsert(spark, path, monkeypatch):
    table, other = VersionedTable(spark, path, ["store"]), VersionedTable(spark, path, ["store"])
    table.upsert(spark.createDataFrame([("a", "p", 1, 1)], ROW))
    real = table.log.commit

    def late(change, tries=50):
        monkeypatch.setattr(table.log, "commit", real)
        other.upsert(spark.createDataFrame([("a", "p", 1, 2), ("b", "p", 1, 3)], ROW))
        return real(change, tries)

    monkeypatch.setattr(table.log, "commit", late)
    table.compact()
    assert rows(table.read()) == [("a", "p", 1, 2), ("b", "p", 1, 3)] and [k for _, k in table.history()] == ["upsert", "upsert", "compact"]


def test_other_columns_are_refused(spark, path):
    table = VersionedTable(spark, path, ["store"])
    with pytest.raises(ValueError):
        table.read()
    table.upsert(spark.createDataFrame([("a", "p", 1, 1)], ROW))
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("a", 1)], "store string, size int"))


# -- growing indexes

DOC = "source string, doc_id long, text string"


def same_index(found, wanted):
    close = lambda frame: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)
    assert rows(found.rows.select("store", "doc", "length", "terms", "tfs")) == rows(wanted.rows)
    assert rows(found.terms) == rows(wanted.terms)
    names = ["store", "n_docs", "avg_length", "floor"]
    assert close(found.stats.select(names)) == close(wanted.stats.select(names))


def test_growing_index_is_what_a_new_one_is(spark, path):
    draw = random.Random(4)
    docs = {(draw.choice(["a", "b", "c"]), i): " ".join(draw.choices("uvwxyz", k=draw.choice([0, 3, 9]))) or draw.choice([None, ""]) for i in range(60)}
    frame = lambda keys: spark.createDataFrame([(*k, docs[k]) for k in keys], DOC).repartition(3)
    index, there = GrowingIndex(spark, path), set()
    names = sorted(docs)
    draw.shuffle(names)
    for i, kind in enumerate(["add", "add", "delete", "add", "merge small", "delete", "add", "delete", "merge"]):
        if kind == "add":
            some, names = names[:14], names[14:]
            index.add(frame(some))
            there |= set(some)
        elif kind == "delete":
            some = draw.sample(sorted(there), 6)
            index.delete(spark.createDataFrame([*some, some[0], ("nowhere", 1)], "store string, doc long"))
            there -= set(some)
        else:
            index.merge(most_docs=14 if kind == "merge small" else None)
        same_index(index.index(), retrieval.lexical_index(frame(sorted(there))))
    assert index.log.latest()[1]["deletions"] == [] and len(index.log.latest()[1]["segments"]) == 1
    assert index.index(2).rows.count() == 28
    index.vacuum(keep=1)
    same_index(index.index(), retrieval.lexical_index(frame(sorted(there))))


def test_documents_come_back(spark, path):
    """Deleted, added again with another text, and a batch that came before."""
    index = GrowingIndex(spark, path)
    index.add(spark.createDataFrame([("a", 1, "x x y"), ("a", 2, "z")], DOC), "s", 0)
    index.delete(spark.createDataFrame([("a", 1)], "store string, doc long"))
    index.add(spark.createDataFrame([("a", 1, "w")], DOC), "s", 1)
    index.add(spark.createDataFrame([("a", 9, "never")], DOC), "s", 1)
    same_index(index.index(), retrieval.lexical_index(spark.createDataFrame([("a", 1, "w"), ("a", 2, "z")], DOC)))


def test_deletions_at_once(spark, path, monkeypatch):
    """Counts are taken again when another deletion was first, so nothing is taken twice."""
    index, other = GrowingIndex(spark, path), GrowingIndex(spark, path)
    index.add(spark.createDataFrame([("a", i, "x y") for i in range(5)], DOC))
    real = index.log.commit

    def late(change, tries=50):
        monkeypatch.setattr(index.log, "commit", real)
        other.delete(spark.createDataFrame([("a", 0), ("a", 1)], "store string, doc long"))
        return real(change, tries)

    monkeypatch.setattr(index.log, "commit", late)
    index.delete(spark.createDataFrame([("a", 1), ("a", 2)], "store string, doc long"))
    same_index(index.index(), retrieval.lexical_index(spark.createDataFrame([("a", i, "x y") for i in (3, 4)], DOC)))


# -- as-of joins

LEFT, RIGHT = "k string, j int, t long, id long", "k string, j int, t long, v long"


def brute_asof(left, right, exact):
    out = []
    for row in left:
        known = [r for r in right if r[:2] == row[:2] and r[2] is not None and row[2] is not None and (r[2] <= row[2] if exact else r[2] < row[2])]
        best = max(known, key=lambda r: (r[2], r[3])) if known else (None,) * 4
        out.append((*row, best[2], best[3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, exact):
    """Null keys and times, ties, repeated rows, and one key that holds most rows."""
    draw = random.Random(6)
    row = lambda last: (draw.choice(["hot"] * 8 + ["b", None]), draw.choice([1, 1, 1, None]), draw.choice([None] + list(range(40))), last)
    left, right = [row(i // 2) for i in range(700)], [row(i) for i in range(250)]
    left += left[:20]
    found = asof.asof_join(spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(5), ["k", "j"], "t", "t", ["v"], ["v"], exact)
    assert rows(found) == brute_asof(left, right, exact)


def test_asof_over_many_ranges(spark):
    """Readings at one end of a key's rows are carried over all the ranges between."""
    left = [("hot", 1, 1000 + i, i) for i in range(4000)]
    right = [("hot", 1, 5, 77), ("hot", 1, 4999, 78), ("hot", 1, 9999, 79)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(asof.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "t", ["v"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert found == sorted(((*r, 4999 if r[2] >= 4999 else 5, 78 if r[2] >= 4999 else 77) for r in left), key=str)


def test_asof_edges(spark):
    left, none = spark.createDataFrame([("a", 1, 5, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert rows(asof.asof_join(left, none, ["k"], "t", "t", ["v"])) == [("a", 1, 5, 1, None, None)]
    assert rows(asof.asof_join(left.limit(0), none, ["k"], "t", "t", ["v"])) == []
    one = spark.createDataFrame([("a", 1, 2, 8)], RIGHT)
    assert rows(asof.asof_join(left, one, [], "t", "t", ["v"], tolerance=F.col("found_time") >= F.col("t") - 3)) == [("a", 1, 5, 1, 2, 8)]
    assert rows(asof.asof_join(left, one, [], "t", "t", ["v"], tolerance=F.col("found_time") >= F.col("t") - 2)) == [("a", 1, 5, 1, None, None)]
    with pytest.raises(ValueError):
        asof.asof_join(left, one, ["k"], "t", "t", ["j"])
