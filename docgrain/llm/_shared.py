"""Tables, shared-folder staging, ordered prefix sums and byte-bounded batches."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python function handles at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts can't make a huge one."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647") == "2147483647":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_process(key: Any, make: Callable[[], Any]) -> Any:
    """An object made once in a Python worker and kept for its later tasks (vocabularies and their bounded memories)."""
    state = sys.modules.setdefault("docgrain_worker_state", types.ModuleType("docgrain_worker_state")).__dict__
    if key not in state:
        state[key] = make()
    return state[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of this machine; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "docgrain-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Staged tables that aren't released yet, in the order of their making.
STAGED: list[DataFrame] = []


def staged(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs survive lost executors without repeating its work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    STAGED.append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, df.staged_path)
        STAGED[:] = [x for x in STAGED if x is not df]


def staged_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what `make` returns, then delete all that was staged on the way to it."""
    before = set(map(id, STAGED))
    out = staged(make())
    release(*(x for x in list(STAGED) if x is not out and id(x) not in before))
    return out


def salted(many: DataFrame, one: DataFrame, key: str, spread: str, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """`many` and `one` (unique by `key`) with what to join them on: keys with more than `rows` rows in `many` are dealt to
    several tasks by a hash of `spread`, and their rows of `one` are copied once for each part. `many` is counted by key.
    """
    salt = f"salt_{key}"
    hot = many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    hot = staged(hot.select(key, F.ceil(F.col("n") / rows).cast("int").alias(f"parts_{key}")))
    if hot.isEmpty():
        release(hot)
        return many, one, [key]
    hot, parts = broadcast_checked(hot), F.coalesce(f"parts_{key}", F.lit(1))
    left = many.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), parts).cast("int")).drop(f"parts_{key}")
    right = one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(f"parts_{key}")
    return left, right, [key, salt]


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, rows: int, how: str = "inner") -> DataFrame:
    """`many` joined with `one` (unique by `key`): broadcast if it is small (see `salted` if not)."""
    small = broadcast_checked(one)
    if small is not one:
        return many.join(small, key, how)
    left, right, on = salted(many, one, key, spread, rows)
    return left.join(right, on, how).drop(f"salt_{key}")


#: Bytes up to which a staged table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def broadcast_checked(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df` marked for broadcast where its counted rows and their width keep it below BROADCAST_BYTES."""
    width = sum({"string": 64, "binary": 64}.get(f.dataType.simpleString(), 8) + 8 for f in df.schema)
    return F.broadcast(df) if df.count() <= min(rows, BROADCAST_BYTES // width) else df


def text_digest(text: Column | str = "text") -> Column:
    """128 bits of a row's own text, null apart from empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit(""))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` but for those whose doc_id (nulls alike) and text are in `gone` (doc_id, digest)."""
    gone = broadcast_checked(staged(gone.select("doc_id", "digest").distinct()))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (text_digest(docs["text"]) == gone["digest"]), "left_anti")


def one_of_twins(docs: DataFrame, twins: DataFrame) -> DataFrame:
    """`docs` with rows whose doc_id and text are in `twins` (doc_id, digest) collapsed to the first by all columns' values."""
    twins = broadcast_checked(staged(twins.select("doc_id", "digest").distinct()))
    if twins.isEmpty():
        return docs
    digest = text_digest(docs["text"])
    same = docs["doc_id"].eqNullSafe(twins["doc_id"]) & (digest == twins["digest"])
    one = docs.join(twins, same, "left_semi").groupBy(docs["doc_id"], digest).agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
    return docs.join(twins, same, "left_anti").union(one.select("row.*"))


#: Bounds that one quantile sketch gives, whose accuracy tells ten times as many apart.
FENCES = 1000


def slice_bounds(df: DataFrame, key: str, slices: int) -> list[int]:
    """Keys that part `df` into about equal slices in key order, from quantile sketches of the key column alone: one of all keys, and
    for more than FENCES slices one of each part between its bounds. The driver gets the bounds, eight bytes a slice."""

    def fences(n: int) -> Column:
        return F.percentile_approx(key, [i / n for i in range(1, n)], 10 * FENCES).alias("b")

    if slices < 2:
        return []
    first = sorted(set(df.agg(fences(min(slices, FENCES))).first()["b"] or []))
    if slices <= FENCES:
        return first
    cuts = np.array(first, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, keys.to_numpy())), keys], names=["part", key])

    parts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key)).mapInArrow(run, f"part long, `{key}` long")
    rows = parts.groupBy("part").agg(fences(-(-slices // FENCES))).select("b").collect()
    return sorted(set(first).union(*(r["b"] for r in rows)))


def by_bytes(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of about `limit` bytes each; a larger item is a run of its own."""
    start = total = i = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, i
            start, total = i, 0
    if start < i:
        yield start, i


def text_runs(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES // 4) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches of about `limit` bytes of text, with the texts (null: empty); a longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for a, b in by_bytes(sizes, limit):
            yield batch.slice(a, b - a), [t or "" for t in texts.slice(a, b - a).to_pylist()]
