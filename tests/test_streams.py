"""Streaming operators and sinks without an oracle."""

import datetime as dt

from pyspark.sql import functions as F

from docgrain.operators import cdc
from docgrain.engine import Engine
from docgrain.plans import registry
from docgrain.streaming import rates, stateful

SCHEMA = "user string, ts timestamp, failed boolean"


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def run(query_of):
    query = query_of.trigger(availableNow=True).start()
    query.awaitTermination()


def test_lockouts_ignore_attempts_while_locked(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("u", at(m), True) for m in range(12)] + [("v", at(m), m % 2 == 0) for m in range(12)]
    s = rates.lockouts(stream_of(spark, tmp_path / "in", rows, SCHEMA), "user", "ts", "failed")
    run(s.writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))
    assert [(r["user"], r["locked_at"]) for r in spark.table("locks").collect()] == [("u", at(4))]


def test_ingest_splits_bad_rows(spark, tmp_path):
    s = stream_of(spark, tmp_path / "in", [(1, "a", 0), (2, None, 0), (3, "c", 3)], "id long, text string, attempts int")
    rates.ingest(s, lambda df: df.select("id"), F.col("text").isNotNull(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out/done")).collect()] == [1]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()) == [2, 3]


def test_repeated_keys_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    s = rates.once(stream_of(spark, tmp_path / "in", [("a", t, True), ("a", t, True), ("b", t, True)], SCHEMA), "user", "ts")
    run(s.writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))
    assert sorted(r["user"] for r in spark.table("uniq").collect()) == ["a", "b"]


def test_document_sink_replaces_only_its_partitions(spark, tmp_path):
    cols = "kb_id string, v int"
    cdc.write_documents(spark.createDataFrame([("a", 1), ("b", 1)], cols), str(tmp_path / "t"))
    cdc.write_documents(spark.createDataFrame([("b", 2)], cols), str(tmp_path / "t"))
    assert {(r["kb_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 2)}


def test_ingested_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    rows = Engine(spark).ingest(pages, "html")
    assert rows.where("token_count > 800 OR content = ''").count() == 0
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/pages.parquet").count()


SEGMENTS = "document string, segment int, ok boolean, attempts int, pages int, total int, all_pages int, ts timestamp"


def test_serial_segments_wait_for_their_turn_and_end(spark, tmp_path):
    """Batches of (document, segment, ok, attempts, pages, total, all_pages, hour), and what they give."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("a", 1, True, 0, 2, 3, 6, 0), ("b", 0, False, 1, 2, 2, 4, 0), ("c", 0, True, 0, 2, 2, 4, 0), ("e", 0, True, 0, 2, 1, 9, 0), ("f", 5, True, 0, 2, 2, 4, 0)],
        [("a", 0, True, 0, 2, 3, 6, 1), ("b", 0, True, 0, 2, 2, 4, 1), ("d", 1, True, 0, 2, 2, 4, 1), ("d", 0, False, 3, 2, 2, 4, 1), ("e", 0, True, 0, 2, 1, 9, 1)],
        [("a", 2, True, 0, 2, 3, 6, 2), ("a", 0, True, 0, 2, 3, 6, 2), ("d", 0, True, 0, 2, 2, 4, 2), ("b", 1, True, 0, 2, 2, 4, 2)],
        [("z", 0, True, 0, 1, 1, 1, 90)],
        [("a", 1, True, 0, 2, 3, 6, 91), ("z", 0, True, 0, 1, 1, 1, 91)],
    ]
    want = {("a", "released", 0), ("a", "released", 1), ("a", "released", 2), ("a", "finalised", 3), ("b", "released", 0), ("b", "released", 1), ("b", "finalised", 2)}
    want |= {("c", "released", 0), ("c", "dead", 1), ("d", "dead", 0), ("e", "released", 0), ("e", "dead", 1), ("f", "dead", 5), ("z", "released", 0), ("z", "finalised", 1)}
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], SEGMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SEGMENTS).parquet(str(tmp_path / "in"))
        query = stateful.serial_segments(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        done = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("document", "event", "segment").collect()))
        if n == 1:
            assert ("a", "released", 1) in done and ("a", "released", 2) not in done and ("c", "dead", 1) not in done
        if n == 2:
            assert ("a", "finalised", 3) in done and ("d", "released", 0) not in done  # a dead document stays dead
        if n == 3:
            assert len(done) == len(set(done)) and set(done) == want
    # The mark of a closed document ended at its deadline: a segment after that begins anew, and waits for its turn.
    assert set(done) == want
    states = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "about").load()
    assert {r["key"][0] for r in states.select("key").collect()} == {"a", "z"}


def test_months_add_up_their_days(spark, tmp_path):
    day = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    rows = [("u", day(1, 1), 1.0), ("u", day(1, 31, 23), 2.0), ("u", day(2, 29, 5), 4.0), ("v", day(1, 15), None), ("u", day(8, 1), 8.0)]
    s = stateful.monthly_counters(stream_of(spark, tmp_path / "in", rows, "user string, ts timestamp, tokens double"), "ts", "user", "tokens")
    run(s.writeStream.format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))
    assert sorted(map(tuple, spark.table("months").collect())) == [("u", "202401", 3.0, 2), ("u", "202402", 4.0, 1), ("v", "202401", 0.0, 1)]
