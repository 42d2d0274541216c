"""A stored inverted index of chunks' tokens: buckets of tokens on disk, kept up by the commits that change documents.

A row holds a token's postings in one run of chunks. Rows are parted by a hash of the token and sorted by token, so a search reads the
asked tokens' buckets, and in these the row groups whose range of tokens has one. Changed documents replace their postings
and deleted ones leave a key that hides them (see sources.snapshots), so the index after updates has the postings of
one that is built anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.sources.snapshots import SnapshotTable

from .rows import bounded_batches, fresh_path, size_checked, staged

SCHEMA = "token string, chunk_ids array<long>, document_ids array<long>, bucket int"
#: Text bytes that one bucket of tokens has postings of; postings that a task inverts at once, and those in a row at most.
BUCKET_BYTES, HELD_POSTINGS, ROW_POSTINGS = 32 << 20, 1 << 20, 4096
#: Buckets and tokens that a search names in the scan's filter; with more asked, the tokens still meet by a join.
NAMED_BUCKETS, NAMED_TOKENS = 4096, 1000


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def inverted(chunks: DataFrame) -> DataFrame:
    """(token, chunk_ids, document_ids): the postings of a run of chunks (chunk_id, document_id, tokens) with a row for each token."""
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            words, chunk, doc = pa.concat_arrays([w for w, _, _ in held]), *(np.concatenate(x) for x in list(zip(*held))[1:])
            held.clear()
            coded = words.dictionary_encode()
            word = coded.indices.to_numpy()
            order = np.lexsort((chunk, word))
            word, chunk, doc = word[order], chunk[order], doc[order]
            new = np.r_[True, word[1:] != word[:-1]]
            at = np.arange(len(word), dtype=np.int32)
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            first = np.flatnonzero(place % ROW_POSTINGS == 0)
            ends = pa.array(np.append(first, len(word)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (chunk, doc)]
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[first])), *lists], names=["token", "chunk_ids", "document_ids"])

        for batch in batches:
            lists = batch.column("tokens")
            times = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            if times.sum():
                held.append((lists.flatten(), *(np.repeat(batch.column(c).to_numpy(), times) for c in ("chunk_id", "document_id"))))
            if sum(len(w) for w, _, _ in held) >= HELD_POSTINGS:
                yield out()
        if held:
            yield out()

    return chunks.select("chunk_id", "document_id", "tokens").mapInArrow(run, "token string, chunk_ids array<long>, document_ids array<long>")


def each(rows: DataFrame) -> DataFrame:
    """(token, chunk_id, document_id) of inverted rows."""
    both = rows.select("token", F.explode(F.arrays_zip("chunk_ids", "document_ids")).alias("x"))
    return both.select("token", F.col("x.chunk_ids").alias("chunk_id"), F.col("x.document_ids").alias("document_id"))


class PostingIndex:
    """The index at `path`, of chunks with document_id and chunk_id whose tokens `tokens` gives."""

    def __init__(self, spark: SparkSession, path: str, tokens: Column):
        self.tokens, self.first = tokens, 8
        self.table = SnapshotTable(spark, path, SCHEMA, "document_id", "bucket", ("token",), self._packed, each)

    def _packed(self, rows: DataFrame) -> DataFrame:
        """Of chunks with their tokens, or of single postings (when segments are merged)."""
        rows = rows if "tokens" in rows.columns else rows.withColumn("tokens", F.array("token"))
        return inverted(rows).withColumn("bucket", bucket_of(F.col("token"), self.table.manifest().notes.get("buckets", self.first)))

    def buckets(self, chunks: DataFrame | None = None) -> int:
        """The number of buckets, which the first chunks' bytes decide and the manifest keeps."""
        notes = self.table.manifest().notes
        if "buckets" in notes or chunks is None:
            return notes.get("buckets", self.first)
        size = chunks.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
        return max(8, math.ceil(size / BUCKET_BYTES))

    def replace(self, job: str, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """All documents that `chunks` has chunks of, and those in `gone` (document_id), have the postings of `chunks` from now on."""
        self.first = self.buckets(chunks)
        rows = None
        if chunks is not None:
            docs = chunks.select("document_id")
            gone = docs if gone is None else gone.select("document_id").union(docs)  # a document may have lost all its tokens
            known = chunks.where("chunk_id IS NOT NULL AND document_id IS NOT NULL")
            rows = known.select(F.array_distinct(self.tokens).alias("tokens"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"))
        return self.table.commit(job, rows, gone, {"buckets": self.first})

    def synced(self, job: str, changes: DataFrame, chunks: DataFrame) -> int:
        """After a run of change detection: `changes` (document_id, action), `chunks` of all documents as they are now.
        New, changed and revived documents are indexed anew, retired ones hidden."""
        changes = staged(changes.select("document_id", "action").where("action IN ('new', 'changed', 'revived', 'retired')"))
        again = size_checked(changes.where("action <> 'retired'").select("document_id"))
        return self.replace(job, chunks.join(again, "document_id", "left_semi"), changes.select("document_id"))

    def postings(self, wanted: DataFrame | None = None) -> DataFrame:
        """(token, chunk_id, document_id); of the tokens in `wanted` (token), whose buckets alone are read."""
        where = None
        if wanted is not None:
            wanted = staged(wanted.select("token").distinct())
            n = self.buckets()
            named = [r["b"] for r in wanted.select(bucket_of(F.col("token"), n).alias("b")).distinct().limit(NAMED_BUCKETS + 1).collect()]
            if len(named) <= NAMED_BUCKETS:
                where = F.col("bucket").isin(named)
            few = [r["token"] for r in wanted.limit(NAMED_TOKENS + 1).collect()]
            if len(few) <= NAMED_TOKENS:
                where = F.col("token").isin(few) & (F.lit(True) if where is None else where)
        rows = self.table.rows(where=where)
        if wanted is not None:
            rows = rows.join(size_checked(wanted), "token", "left_semi")
        return rows.select("token", "chunk_id", "document_id")

    def asked(self, seen: DataFrame, terms: DataFrame) -> DataFrame:
        """(principal_id, chunk_id, token) of the chunks in `seen` (principal_id, chunk_id) for the tokens that questions ask for."""
        return self.postings(terms).join(seen.select("principal_id", "chunk_id"), "chunk_id").select("principal_id", "chunk_id", "token")


#: Indexes made in this session, by their source's files.
STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, source: str, tokens: Column, chunks: Callable[[], DataFrame]) -> PostingIndex:
    """The index of `source`, a folder or file that `chunks` reads; made by the session's first search, and again if a file has
    changed since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(path))
    key = (spark.sparkContext.applicationId, str(tokens), *files)
    if key not in STORED or not PostingIndex(spark, STORED[key], tokens).table.manifest().version:
        index = PostingIndex(spark, fresh_path(spark, "postings"), tokens)
        index.replace("first", chunks())
        STORED[key] = index.table.path
    return PostingIndex(spark, STORED[key], tokens)
