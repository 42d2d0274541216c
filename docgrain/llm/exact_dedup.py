"""Exact deduplication with counting quotient filters.

Every partition turns its documents' fingerprints into counting quotient filters, one for each range of quotients: the
quotients' run lengths, the remainders in sorted order and a counter for each. Filters of one range merge losslessly,
as two sorted runs do. Fingerprints whose merged count is above one lead to byte verification: only their documents'
texts are compared, by grouping on the normalised text itself, which collapses copies before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import broadcast_checked, release, salted_join, shared_dir, staged, table

#: Bits of a fingerprint, those of a quotient within a filter, and the entries that a filter has on average: the high bits
#: that choose a filter follow from the counted rows. What is left is the remainder.
FINGERPRINT_BITS, QUOTIENT_BITS, FILTER_ENTRIES = 60, 16, 1 << 19
#: Repeated fingerprints (at most 150 bytes each with their class) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of one text beyond which they are dealt to several tasks of a join.
HOT_ROWS = 200_000

#: Fixed by the contract: what normalisation deletes.
BLANKS = r"[\x20\x09-\x0D]"
FILTERS = "range int, runs binary, remainders binary, counts binary"


class QuotientFilter:
    """Counting quotient filter over one range: occupied quotients and their run lengths, sorted remainders, counters."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.runs, self.remainders, self.counts, self.bits = quotients, runs, remainders, counts, bits

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From distinct sorted values (quotient, then a remainder of `bits` bits) and their counts."""
        quotients, runs = np.unique(values >> bits, return_counts=True)
        return cls(quotients, runs, values & ((1 << bits) - 1), counts, bits)

    def values(self) -> np.ndarray:
        return np.repeat(self.quotients, self.runs) << self.bits | self.remainders

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """All entries of the filters, equal ones with their counts summed."""
        if len(filters) == 1:
            return filters[0]
        both = np.concatenate([f.values() for f in filters])
        order = np.argsort(both, kind="stable")  # sorted runs: merges
        both, counts = both[order], np.concatenate([f.counts for f in filters])[order]
        first = np.flatnonzero(np.diff(both, prepend=-1)) if len(both) else np.zeros(0, np.int64)
        return cls.of(both[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Run lengths as (quotient, length) of the occupied quotients, remainders in 6 bytes, counters."""
        return np.stack([self.quotients, self.runs], 1).astype("<u4").tobytes(), self.remainders.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), self.counts.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, runs: bytes, remainders: bytes, counts: bytes, bits: int) -> QuotientFilter:
        used = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64)
        wide = np.zeros((len(remainders) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(remainders, np.uint8).reshape(-1, 6)
        return cls(used[:, 0], used[:, 1], wide.view("<i8").ravel(), np.frombuffer(counts, "<i8"), bits)


class Merging:
    """Filters of one range, merged whenever as many entries wait as are merged already: n log n in all."""

    def __init__(self):
        self.done: list[QuotientFilter] = []
        self.waiting: list[QuotientFilter] = []

    def add(self, new: QuotientFilter) -> None:
        self.waiting.append(new)
        if sum(len(f.remainders) for f in self.waiting) >= sum(len(f.remainders) for f in self.done):
            self.result()

    def result(self) -> QuotientFilter:
        self.done, self.waiting = [QuotientFilter.merged([*self.done, *self.waiting])], []
        return self.done[0]


def range_bits(rows: int) -> int:
    """High bits of the fingerprint that choose a filter, so that one has about FILTER_ENTRIES entries at most."""
    return max(0, math.ceil(math.log2(max(rows, 1) / FILTER_ENTRIES)))


def partition_filters(fingerprints: DataFrame, high: int) -> DataFrame:
    """The filters of each partition's own rows, one for each range that occurs."""
    low = FINGERPRINT_BITS - high
    bits = low - QUOTIENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Merging()  # over all ranges, then cut by range
        for batch in batches:
            found, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            own.add(QuotientFilter.of(found, counts, bits))
        if own.done:
            whole = own.result()
            values = whole.values()
            ranges, starts = np.unique(values >> low, return_index=True)
            for r, a, b in zip(ranges.tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)]):
                one = QuotientFilter.of(values[a:b] & ((1 << low) - 1), whole.counts[a:b], bits)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in one.packed())], names=["range", "runs", "remainders", "counts"])

    return fingerprints.select("fingerprint").mapInArrow(run, FILTERS)


def repeated(filters: DataFrame, high: int) -> DataFrame:
    """(fingerprint, n) of the merged filters' entries with a count above one."""
    low = FINGERPRINT_BITS - high
    bits = low - QUOTIENT_BITS

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Merging()
        for batch in batches:
            for row in batch.to_pylist():
                total.add(QuotientFilter.unpacked(row["runs"], row["remainders"], row["counts"], bits))
        whole = total.result()
        many = whole.counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(whole.values()[many] | key[0].as_py() << low), pa.array(whole.counts[many])], names=["fingerprint", "n"])

    return filters.groupBy("range").applyInArrow(merge, "fingerprint long, n long")


def normalised(text: Column | str = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprint_of(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII blanks; a null text counts as empty. The row with the most
    code points in its original text stays, then the smallest doc_id (a null id last); of rows with one id the longer
    one. A repeated row (same id and length) is decided like its twin and counted in group_size. Other columns don't
    matter; an empty table gives no rows.
    """
    return decided(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def decided(docs: DataFrame) -> DataFrame:
    """The rows of `deduplicate` with n_points (the original text's code points) and twins (rows that tie for the place)."""
    digest = F.sha2(normalised(), 256)
    points = F.length(F.coalesce("text", F.lit("")))
    rows = staged(docs.select("doc_id", points.alias("n_points"), digest.alias("text_sha256")).withColumn("fingerprint", fingerprint_of(F.col("text_sha256"))))
    high = range_bits(rows.count())
    many = staged(repeated(partition_filters(rows, high), high))
    few = many.count() <= BROADCAST_ROWS
    narrow = many.select("fingerprint")
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("body", normalised())
    full = full.withColumn("text_sha256", F.sha2("body", 256)).withColumn("fingerprint", fingerprint_of(F.col("text_sha256")))
    suspects = full.join(F.broadcast(narrow) if few else narrow, "fingerprint", "left_semi")
    # Byte verification: the text itself is the grouping key. Each task sends one row for each distinct text and place.
    place = suspects.groupBy("body", F.length("text").alias("m"), "doc_id").agg(F.count("*").alias("rows"), F.first("text_sha256").alias("text_sha256"))
    order = F.struct((-F.col("m")).alias("m"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("rows").alias("twins"))
    classes = place.groupBy("body").agg(F.min(order).alias("first"), F.sum("rows").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    classes = staged(classes.where("group_size > 1").select("text_sha256", F.col("first.i").alias("keep_id"), (-F.col("first.m")).alias("keep_points"), F.col("first.twins").alias("twins"), "group_size"))
    rows = rows.select("doc_id", "n_points", "text_sha256")
    out = rows.join(F.broadcast(classes), "text_sha256", "left") if few else salted_join(rows, classes, "text_sha256", "doc_id", HOT_ROWS, "left")
    alone = F.col("group_size").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "n_points", F.coalesce("twins", F.lit(1)).alias("twins"), F.coalesce("keep_points", "n_points").alias("keep_points"))
    release(many)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).drop("keep_points")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each group; of twins (same id, text and length) the first by their columns' values.

    A row is told by its id and its own text, so a different text under the same id is left alone.
    """
    found = staged(decided(docs))
    digest, points = F.sha2(normalised(docs["text"]), 256), F.length(F.coalesce(docs["text"], F.lit("")))

    def chosen(which: Column | str) -> DataFrame:
        return broadcast_checked(staged(found.where(which).select("doc_id", "text_sha256", "n_points").distinct()))

    def same(some: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(some["doc_id"]) & (digest == some["text_sha256"]) & (points == some["n_points"])

    # The names of the other side's columns can't clash: they are bound to it, and don't come out of a semi or anti join.
    gone, twins = chosen(~F.col("kept")), chosen("kept AND twins > 1")
    stay = docs.join(gone, same(gone), "left_anti")
    if twins.isEmpty():
        return stay
    key = [docs["doc_id"], digest, points]
    one = stay.join(twins, same(twins), "left_semi").groupBy(*key).agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
    return stay.join(twins, same(twins), "left_anti").union(one.select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, d.text_sha256 FROM d JOIN k USING (text_sha256)
"""
}
