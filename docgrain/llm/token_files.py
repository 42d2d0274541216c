"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file set is a Parquet folder of blocks plus a small `ranks` folder. A block holds consecutive documents of one slice of
the doc_id order: their ids' ranks (0: the most frequent id of the corpus) take one to four bytes each; the lengths, two
bits each, stand apart in control bytes, so that a table lookup by control byte finds all offsets at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import WordIds, tokenizer
from ._shared import bounded_batches, per_process, release, remove, shared_dir, slice_bounds, staged, table, text_runs

#: Ids in a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of text in a slice of the doc_id order: on average at most the first, at least the second. A repeated doc_id is in one
#: slice, however often it comes; its task sorts and streams it, so what it holds doesn't grow with it.
SLICE_BYTES, SMALLEST_SLICE = 64 << 20, 4 << 20
BLOCKS = "slice int, before long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def control_table() -> np.ndarray:
    """Row c: the four byte lengths that control byte c stands for."""
    c = np.arange(256)[:, None]
    return (c >> np.array([0, 2, 4, 6]) & 3) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype(np.uint32, copy=False)
    sizes = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    at = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        m = sizes > k
        data[at[m] + k] = ranks[m] >> (8 * k) & 255
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = control_table()[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data + bytes(3), np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(sizes > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def width(vocabulary: int) -> str:
    """How ids are held until they are ranked: in two bytes where the vocabulary allows."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int], held: str) -> DataFrame:
    """(slice, doc_id, ids): ids of each text and the end id; `slice` counts the bounds below the doc_id (null: none)."""
    bounded_batches(docs.sparkSession)
    end, cuts = int(end_id).to_bytes(4, "little"), np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_process(("folded", tokenizer_path), lambda: WordIds(tokenizer_path, space=False, fold=True))
        for batch, texts in text_runs(batches):
            keys = batch.column("doc_id")
            at = np.where(keys.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(cuts, pa.compute.fill_null(keys, 0).to_numpy()), 0)
            ids = [np.frombuffer(ids_of.text(t) + end, "<u4").astype(held).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), keys, pa.array(ids, pa.binary())], names=["slice", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "slice int, doc_id long, ids binary")


def placed(ids: DataFrame, size: int) -> DataFrame:
    """`ids` with `before`: the ids of a slice ahead of each row. Each slice is whole and in order in one task here; once it
    is staged, several tasks may read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            slices = batch.column("slice").to_numpy()
            n = pa.compute.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // size
            starts = np.cumsum(n) - n
            new = np.concatenate([[slices[0] != last], slices[1:] != slices[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            before = starts - np.where(first >= 0, starts[first], -total)
            last, total = slices[-1], int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("doc_id"), pa.array(before), batch.column("ids")], names=["slice", "doc_id", "before", "ids"])

    return ids.mapInArrow(run, "slice int, doc_id long, before long, ids binary")


def rank_order(ids: DataFrame, vocabulary: int, held: str) -> np.ndarray:
    """Ids by falling corpus frequency (ties: by id); the driver gets one row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), held), minlength=vocabulary)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return np.argsort(-counts, kind="stable")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Write the token files of `docs` (doc_id, text) to `path`, in ascending doc_id order (nulls first).

    A null or empty text has the end id alone; a repeated row is written again, in any order among its like; other
    columns don't matter; an empty table gives files without blocks. The encoded ids are staged in the shared folder
    until the files are written.
    """
    vocabulary = max(tokenizer(tokenizer_path).get_vocab_size(), end_id + 1)
    held = width(vocabulary)
    size = np.dtype(held).itemsize
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices = max(1, math.ceil(text_bytes / SLICE_BYTES), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(text_bytes / SMALLEST_SLICE)))
    coded = encode(docs, tokenizer_path, end_id, slice_bounds(docs.select("doc_id"), "doc_id", slices), held)
    ids = staged(placed(coded.repartition(slices, "slice").sortWithinPartitions("slice", "doc_id"), size), compression="zstd")
    order = rank_order(ids, vocabulary, held)
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)

    def block(rows: list[tuple], at: int, before: int) -> pa.RecordBatch:
        control, data = pack_ranks(ranks[np.frombuffer(b"".join(r[1] for r in rows), held)])
        columns = [[at], [before], [[r[0] for r in rows]], [[len(r[1]) // size for r in rows]], [control], [data]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["slice", "before", "doc_ids", "lengths", "control", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, first, total = None, 0, 0
        for batch in batches:
            for s, doc, before, ids in zip(*(batch.column(c).to_pylist() for c in ("slice", "doc_id", "before", "ids"))):
                if rows and (s != at or before != first + total or total >= BLOCK_IDS):  # a block's rows follow one another
                    yield block(rows, at, first)
                    rows, total = [], 0
                if not rows:
                    at, first = s, before
                rows.append((doc, ids))
                total += len(ids) // size
        if rows:
            yield block(rows, at, first)

    ids.select("slice", "doc_id", "before", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    release(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the token files at `path`; start: ids of all documents before it."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # as long as the vocabulary
    by_rank = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        by_rank[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    first, total = {}, 0
    for r in blocks.groupBy("slice").agg(F.sum(length).alias("n")).orderBy("slice").collect():  # one row a slice
        first[r["slice"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n = np.array(b["lengths"], np.int64)
                ends = np.cumsum(n)
                ids = by_rank[unpack_ranks(b["control"], b["data"], int(ends[-1]))].astype("<u4").tobytes()
                starts = ends - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(starts + first[b["slice"]] + b["before"]), pa.array(n), pa.array([ids[4 * s : 4 * e] for s, e in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = staged(read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    remove(spark, path)
    return out


QUERIES = {"op5_token_files": op5_token_files}
