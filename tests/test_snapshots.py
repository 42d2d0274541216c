"""Atomic replacement of documents' rows, and the inverted index that it keeps up."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import postings
from docgrain.operators.postings import PostingIndex
from docgrain.sources import snapshots
from docgrain.sources.snapshots import SnapshotTable

SCHEMA = "document_id long, chunk_id long, content string"


def table(spark, path, **more):
    return SnapshotTable(spark, f"file://{path}/t", SCHEMA, "document_id", **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(t, at=None):
    return sorted(map(tuple, t.rows(at).select("document_id", "chunk_id", "content").collect()))


def test_readers_see_the_old_or_the_new_document(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    assert held(t) == [] and t.manifest().version == 0
    old, new = [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], [(1, 1, "x")]
    t.commit("load", frame(spark, old))
    reader, before = t.manifest(), t.rows()

    def broken(self, path, text):
        raise OSError("the disk is gone")

    with monkeypatch.context() as m:  # the segment is written, its manifest isn't
        m.setattr(snapshots.Files, "publish", broken)
        with pytest.raises(OSError):
            t.commit("parse", frame(spark, new))
    assert held(t) == old and t.manifest().version == 1 and len(t.files.names(f"{t.path}/segments")) == 2
    with pytest.raises(Exception, match="by zero|DIVIDE"):  # nor is anything seen of a job that fails halfway
        t.commit("bad rows", frame(spark, new).withColumn("content", F.expr("CAST(assert_true(false, 'DIVIDE') AS STRING)")))
    assert held(t) == old
    assert t.commit("parse", frame(spark, new)) == 2
    assert held(t) == [(1, 1, "x"), (2, 3, "c")]
    assert held(t, reader) == old and sorted(map(tuple, before.collect())) == old  # who began before still reads the old ones
    assert t.commit("parse", frame(spark, [(1, 9, "again")])) == 2 and held(t) == [(1, 1, "x"), (2, 3, "c")]
    assert len(t.clean(keep=1)) == 2 and held(t) == [(1, 1, "x"), (2, 3, "c")]


def test_writers_at_once(spark, tmp_path):
    t = table(spark, tmp_path)
    jobs = [threading.Thread(target=table(spark, tmp_path).commit, args=(f"job {i}", frame(spark, [(i, i, "v"), (99, i, "last")]))) for i in range(5)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    m = t.manifest()
    assert m.version == 5 and sorted(m.jobs) == [f"job {i}" for i in range(5)]
    rows = held(t)
    assert [r for r in rows if r[0] != 99] == [(i, i, "v") for i in range(5)] and len([r for r in rows if r[0] == 99]) == 1


def test_a_taken_number_is_published_on_top(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.commit("load", frame(spark, [(1, 1, "a"), (2, 2, "b")]))
    publish, came = snapshots.Files.publish, []

    def late(self, path, text):
        if not came:
            came.append(1)
            other.commit("first", frame(spark, [(1, 1, "first")]))
        return publish(self, path, text)

    monkeypatch.setattr(snapshots.Files, "publish", late)
    assert t.commit("second", frame(spark, [(1, 1, "second"), (3, 3, "c")])) == 3
    assert held(t) == [(1, 1, "second"), (2, 2, "b"), (3, 3, "c")]


def test_many_commits_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_SEGMENTS", 3)
    t, want, r = table(spark, tmp_path), {}, random.Random(4)
    for i in range(9):
        rows = [(d, 10 * d + k, f"v{i}") for d in r.sample(range(6), 2) for k in range(r.randrange(3))]
        gone = r.sample(range(6), 2)
        for d in {x[0] for x in rows} | set(gone):
            want[d] = [x for x in rows if x[0] == d]
        t.commit(f"job {i}", frame(spark, rows), spark.createDataFrame([(g,) for g in gone], "document_id long"))
        assert held(t) == sorted(x for xs in want.values() for x in xs)
    assert len(t.manifest().segments) <= 3


def content(r):
    return " ".join(r.choice(["alpha", "Beta", "并发编程", "x9", "a_b", "，", "q"]) for _ in range(r.randrange(12)))


def test_index_after_updates_is_the_index_rebuilt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "HELD_POSTINGS", 7)
    monkeypatch.setattr(postings, "ROW_POSTINGS", 2)
    monkeypatch.setattr(snapshots, "MOST_SEGMENTS", 4)
    tokens, r = T.index_tokens(F.lower("content")), random.Random(2)
    index = PostingIndex(spark, f"file://{tmp_path}/index", tokens)
    now = {d: [(d, 10 * d + k, content(r)) for k in range(1 + r.randrange(3))] for d in range(12)}
    all_rows = lambda: frame(spark, [x for xs in now.values() for x in xs])
    index.replace("first", all_rows())

    def rebuilt():
        fresh = all_rows().select(F.explode(F.array_distinct(tokens)).alias("token"), "chunk_id", "document_id")
        return sorted(map(tuple, fresh.collect()))

    for i in range(7):
        changed, new, gone = r.sample(sorted(now), 3), [20 + i], r.sample(sorted(now), 1)
        changed = [c for c in changed if c not in gone]
        for d in changed + new:
            now[d] = [(d, 10 * d + k, content(r)) for k in range(r.randrange(3))]
        for d in gone:
            del now[d]
        actions = [(d, "changed") for d in changed] + [(d, "new") for d in new] + [(d, "retired") for d in gone] + [(d, "unchanged") for d in now if d not in changed + new]
        for _ in range(2):
            index.synced(f"sync {i}", spark.createDataFrame(actions, "document_id long, action string"), all_rows())
        assert sorted(map(tuple, index.postings().collect())) == rebuilt()
    index.replace("purge", gone=spark.createDataFrame([(d,) for d in sorted(now)[:3]], "document_id long"))
    for d in sorted(now)[:3]:
        del now[d]
    assert sorted(map(tuple, index.postings().collect())) == rebuilt()
    some = spark.createDataFrame([("beta",), ("并发",), ("nowhere",)], "token string")
    assert sorted(map(tuple, index.postings(some).collect())) == [x for x in rebuilt() if x[0] in ("beta", "并发")]


def test_a_search_reads_the_asked_buckets_only(spark, sf, tmp_path):
    chunks = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index = PostingIndex(spark, f"file://{tmp_path}/index", T.index_tokens(F.lower("content")))
    index.replace("first", chunks)
    found = index.postings(spark.createDataFrame([("the",)], "token string"))
    files = {f for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert found.count() == chunks.where(F.array_contains(T.index_tokens(F.lower("content")), "the")).count() > 0
    assert len(index.table.files.names(f"{index.table.path}/segments")) == 1 and files


def test_a_changed_source_is_indexed_again(spark, tmp_path):
    tokens = T.index_tokens(F.lower("content"))
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    frame(spark, [(1, 1, "old words")]).write.parquet(f"{tmp_path}/docs")
    one = postings.stored(spark, f"file://{tmp_path}/docs", tokens, read)
    assert postings.stored(spark, f"file://{tmp_path}/docs", tokens, read).table.path == one.table.path
    frame(spark, [(1, 1, "new")]).write.mode("overwrite").parquet(f"{tmp_path}/docs")
    two = postings.stored(spark, f"file://{tmp_path}/docs", tokens, read)
    assert [r["token"] for r in two.postings().collect()] == ["new"]
