"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two: as many full sequences as fit, then the
binary digits of the rest from high to low. A piece is a sequence of its own, so no sequence crosses documents and
none needs padding; equal lengths share a bucket, from which batches of one shape are drawn.

Nothing is shuffled: a sequence's id is made of its bucket, its partition and its place there, which a repeated task
makes again alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import WordIds
from ._shared import bounded_batches, per_process, table, text_runs

SCHEMA = "doc_id long, bucket int, sequence_id long, offset long, start long, length long, ids binary, doc_tokens long"


def binary_lengths(n: int, capacity: int) -> list[int]:
    """Powers of two, at most `capacity` each, from high to low, that add up to n."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in range(capacity.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Sequences of `docs` (doc_id, text): one row per piece, with its little-endian 32-bit ids.

    A null or empty text gives the end id alone. A repeated row is packed again. A null doc_id is kept. Other columns
    don't matter. An empty table gives no rows. `capacity` must be a power of two.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_process(("words", tokenizer_path), lambda: WordIds(tokenizer_path, space=True))
        task, place = TaskContext.get().partitionId(), [0] * 64
        for batch, texts in text_runs(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = ids_of.text(text) + end
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total, capacity):
                    bucket = length.bit_length() - 1
                    out.append((doc, bucket, bucket << 57 | task << 33 | place[bucket], 0, start, length, ids[4 * start : 4 * (start + length)], total))
                    place[bucket] += 1
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]


def pieces(packed: DataFrame) -> DataFrame:
    """The digest columns of packed sequences."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op3_packing": op3_packing}
