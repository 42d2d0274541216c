"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are dealt into groups; a group's partial product is a local score, and the groups' lists of local
scores are kept apart: a row's total is only made where a phase asks for it.

1. Gather: on the lead blocks, a fixed share of the row blocks, each group lists its best local scores; the rows on these
   lists get their totals, whose k-th best is a safe lower bound for the block, and the block's other sufficient rows are
   resolved under it. The k-th best total of all lead blocks is the cutoff: as these are totals of rows, it never lies
   above the k-th best of all.
2. Collect: the cutoff goes to all other blocks with the queries. A row whose local scores all lie under cutoff / groups
   can't reach it, so only entries with a local score at or above that share are collected.
3. Resolve: only collected rows get their totals, and only totals that reach the cutoff leave the task. Within a task the
   cutoff rises with the totals already found.

Every pair of query and row is met in one block of one phase, so its local scores are computed once.

Queries and rows meet in blocks on a grid: a row block is sent to each query column of its grid row, a query block to each
row of its column, so that every pair of blocks meets once. The grid grows with the number of block pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, staged, table

#: Two groups: a sum of two reaches the cutoff only if one reaches its half, which few do; more groups let more through.
ROW_BLOCK, QUERY_BLOCK, GROUPS = 2048, 256, 2
#: One row block in so many is a lead block, and a table has about as many blocks at least.
LEAD = 8
#: Block pairs that a task scores.
TASK_PAIRS = 64
#: Below every score, and its negative is a number too.
NO_SCORE = -np.iinfo(np.int64).max
BLOCK = "block long, ids binary, parts binary, width int, cuts binary"


def usable(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; without vectors that are null or hold null or non-finite ones."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(fine).select("vec_id", F.transform(x, lambda e: F.greatest(F.floor(e.cast("double") * scale), F.lit(NO_SCORE))).alias("v"))


def blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Blocks of `size` rows (vec_id, v, cut); shorter vectors are padded with zeros to `width`, numbers take the bytes they need."""

    def pack(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        ids, cuts, parts = [], [], []
        for b in held:
            ids.append(b.column("vec_id").to_numpy())
            cuts.append(pa.compute.fill_null(b.column("cut"), NO_SCORE).to_numpy())
            lists = b.column("v")
            lengths = pa.compute.list_value_length(lists).to_numpy()
            at = np.repeat(np.arange(len(lists)) * width, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            part = np.zeros(len(lists) * width, np.int64)
            part[at] = lists.flatten().to_numpy()
            parts.append(part)
        part = np.concatenate(parts)
        size_of = next(w for w in (2, 4, 8) if w == 8 or max(int(part.max(initial=0)), -int(part.min(initial=0))) < 1 << (8 * w - 1))
        columns = [[TaskContext.get().partitionId() << 33 | number], [np.concatenate(ids).tobytes()], [part.astype(f"<i{size_of}").tobytes()], [size_of], [np.concatenate(cuts).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=["block", "ids", "parts", "width", "cuts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = number = 0
        for batch in batches:
            while batch.num_rows:
                take = min(size - count, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, count = batch.slice(take), count + take
                if count == size:
                    yield pack(held, number)
                    held, count, number = [], 0, number + 1
        if held:
            yield pack(held, number)

    return rows.select("vec_id", "v", "cut").mapInArrow(run, BLOCK)


def local_scores(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Partial products of each group of dimensions; in floating point where that is exact (below 2^53), else in 64-bit
    integers, and in Python's where even those overflow: scores beyond 64 bits then count as the outermost ones."""
    bound = max(float(np.abs(q.astype(float)).max(initial=0)), 1) * max(float(np.abs(r.astype(float)).max(initial=0)), 1) * max(q.shape[1], 1)
    if bound < 2**53:
        q, r = q.astype(np.float64), r.astype(np.float64)
    elif bound >= 2**62:
        q, r = q.astype(object), r.astype(object)
    local = [q[:, c] @ r[:, c].T for c in np.array_split(np.arange(q.shape[1]), GROUPS)]
    if q.dtype != object:
        return [s.astype(np.int64) for s in local]
    total = np.clip(sum(local), NO_SCORE + 1, -NO_SCORE - 1).astype(np.int64)
    share = total // GROUPS  # of a clipped total, so that the groups still add up to it
    return [share] * (GROUPS - 1) + [total - share * (GROUPS - 1)]


def leading(local: list[np.ndarray], other: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: which rows are on a group's list of each query's k best local scores."""
    lead = np.zeros(other.shape, bool)
    for s in local:
        at = np.argpartition(-np.where(other, s, NO_SCORE), k - 1, axis=1)[:, :k] if s.shape[1] > k else np.arange(s.shape[1])[None, :]
        np.put_along_axis(lead, at, True, axis=1)
    return lead & other


def kth_best(query: np.ndarray, score: np.ndarray, queries: int, k: int) -> np.ndarray:
    """Each query's k-th best of the scores listed; NO_SCORE where there are fewer."""
    order = np.lexsort((-score, query))
    first = np.searchsorted(query[order], np.arange(queries))
    out, at = np.full(queries, NO_SCORE), first + k - 1
    full = np.bincount(query, minlength=queries) >= k
    out[full] = score[order][at[full]]
    return out


def sufficient(local: list[np.ndarray], other: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: places (query, row) with a local score at or above the cutoff's share."""
    share = -(-cut // len(local))[:, None]  # rounded up: the groups' whole numbers reach the cutoff only if one reaches this
    enough = local[0] >= share
    for s in local[1:]:
        enough |= s >= share
    return np.nonzero(enough & other)


def totals(local: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Phase 3: exact scores of the places asked for."""
    return sum(s[i, j] for s in local)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: by falling score, then smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


class Found:
    """The best entries of each query block in one task, and the cutoffs that they prove."""

    def __init__(self, k: int):
        self.k, self.cuts, self.held = k, {}, {}

    def cut(self, block: int, given: np.ndarray) -> np.ndarray:
        return np.maximum(given, self.cuts.get(block, NO_SCORE))

    def add(self, block: int, q: np.ndarray, i: np.ndarray, v: np.ndarray, score: np.ndarray) -> None:
        if block in self.held:
            _, *old = self.held[block]
            i, v, score = (np.concatenate(x) for x in zip(old, (i, v, score)))
        at = best(i, v, score, self.k)
        self.held[block] = (q, i[at], v[at], score[at])
        self.cuts[block] = kth_best(i[at], score[at], len(q), self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for q, i, v, score in self.held.values():
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(v), pa.array(score)], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, made: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where `is_query` holds, but for rows of its own id.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; of vectors of different length the shorter counts as padded with zeros. Repeated rows are rows of their
    own, but one query; of several vectors under one query id the first in order of their components asks. With no queries, or
    no other rows, there is no result. Scores are 64-bit integers; scaled components and scores beyond that range count as
    its ends. Other columns don't matter. `made` counts pairs that the cutoff was held against, and those that got a total.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors).withColumn("cut", F.lit(None).cast("long"))
    about = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width = about["w"] or 1
    row_blocks = staged(blocks(rows, min(ROW_BLOCK, max(1, about["n"] // LEAD)), width).withColumn("draw", F.xxhash64("block")))
    first = row_blocks.agg(F.min(F.struct(F.pmod("draw", F.lit(LEAD)).alias("m"), "draw")).alias("first")).first()["first"]
    lead = F.pmod("draw", F.lit(LEAD)) == 0
    row_blocks = row_blocks.withColumn("lead", lead if first is None or first["m"] == 0 else F.col("draw") == first["draw"])
    queries = usable(vectors.where(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))

    def meet(some: DataFrame, query_blocks: DataFrame) -> DataFrame:
        """Each pair of a row block and a query block once; a cell of the grid is a task of about TASK_PAIRS pairs."""
        n, m = max(1, some.count()), max(1, query_blocks.count())
        cells = math.ceil(n * m / TASK_PAIRS)
        down = min(n, max(1, math.ceil(math.sqrt(cells * n / m))))
        across = min(m, max(1, math.ceil(cells / down)))
        spread = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
        left = some.select("ids", "parts", "width", F.pmod(F.xxhash64("block"), F.lit(down)).cast("int").alias("r"), spread(across).alias("c"))
        right = query_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("parts").alias("q_parts"), F.col("width").alias("q_width"), "cuts", F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("c"), spread(down).alias("r"))
        tasks = max(down * across, 1)
        both = left.repartition(tasks, "r", "c").join(right.repartition(tasks, "r", "c"), ["r", "c"])
        return both.select("ids", "parts", "width", "q_block", "q_ids", "q_parts", "q_width", "cuts")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                v, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                part, q_part = np.frombuffer(row["parts"], f"<i{row['width']}").reshape(-1, width), np.frombuffer(row["q_parts"], f"<i{row['q_width']}").reshape(-1, width)
                yield row["q_block"], q, v, local_scores(q_part.astype(np.int64), part.astype(np.int64)), q[:, None] != v[None, :], np.frombuffer(row["cuts"], "<i8")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(k)
        for block, q, v, local, other, cuts in scored(batches):
            i, j = np.nonzero(leading(local, other, k))
            cut = np.maximum(found.cut(block, cuts), kth_best(i, totals(local, i, j), len(q), k))
            i, j = sufficient(local, other, cut)
            score = totals(local, i, j)
            reach = score >= cut[i]
            found.add(block, q, i[reach], v[j[reach]], score[reach])
        yield from found.batches()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(k)
        for block, q, v, local, other, cuts in scored(batches):
            cut = found.cut(block, cuts)
            i, j = sufficient(local, other, cut)
            if made:
                made[0].add(other.size)
                made[1].add(len(i))
            score = totals(local, i, j)
            reach = score >= cut[i]
            found.add(block, q, i[reach], v[j[reach]], score[reach])
        yield from found.batches()

    schema = "query_id long, vec_id long, score long"
    first = meet(row_blocks.where("lead"), staged(blocks(queries.withColumn("cut", F.lit(None).cast("long")), QUERY_BLOCK, width))).mapInArrow(gather, schema)
    first = staged(best_of(first, k))
    cutoffs = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("cut"))
    cut_queries = queries.join(cutoffs, queries.vec_id == cutoffs.query_id, "left").select("vec_id", "v", "cut")
    rest = meet(row_blocks.where("NOT lead"), staged(blocks(cut_queries, QUERY_BLOCK, width))).mapInArrow(resolve, schema)
    return best_of(first.drop("rank").union(rest), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op9_topk_search": op9_topk_search}
SQL = {
    "op9_topk_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
