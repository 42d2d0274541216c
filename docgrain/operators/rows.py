"""Row helpers: staging, checked broadcasts, spread joins, top rows, paging, ordered budgets."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows up to which a side is broadcast (at most about 1 kB each).
BROADCAST_ROWS = 20_000
#: Rows of the larger side that one salt of a spread join takes.
SPREAD_ROWS, MOST_SALTS = 250_000, 4096


#: Bytes of an Arrow batch that goes to Python, where the session leaves them unbounded.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts can't make a huge one. A worker's memory is a small multiple
    of a batch, so it doesn't grow with the rows of a partition."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647") == "2147483647":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local session gets one of this machine and a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "docgrain-shared")
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that this session has staged rows in.
STAGED: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that lost executors and later uses don't repeat its work."""
    path = fresh_path(df.sparkSession, "rows")
    df.write.parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all that was staged so far, once the results that read it are written; how many folders that were."""
    gone = len(STAGED)
    while STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def dealt(df: DataFrame) -> DataFrame:
    """`df` spread over the session's cores where its files hold fewer partitions than that (a table of one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def size_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is small; else left to a shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread_join(many: DataFrame, few: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join on a key with few distinct values. A small side is broadcast; a larger one is repeated for as many salts as the
    other side's counted rows need, over which those are dealt, so that no key lands in one task."""
    if is_small(few):
        return many.join(F.broadcast(few), key, how)
    salts = min(MOST_SALTS, -(-many.count() // SPREAD_ROWS)) or 1
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


#: Rows of one key that one task of a hub join takes.
HUB_ROWS = 100_000


def hub_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join on a key of which `right` may have very many rows: those are dealt to tasks by a hash of `spread_by`, and only the
    rows of `left` with such a key are repeated, once for each of its tasks."""
    hubs = staged(right.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HUB_ROWS).select(F.col(key).alias("_hub"), F.ceil(F.col("n") / HUB_ROWS).cast("int").alias("_parts")))
    if hubs.isEmpty():
        return left.join(right, key, how)
    hubs, parts = size_checked(hubs), F.coalesce("_parts", F.lit(1))
    many = right.join(hubs, right[key] == hubs["_hub"], "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_hub", "_parts")
    few = left.join(hubs, left[key] == hubs["_hub"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hub", "_parts")
    return few.join(many, [key, "_salt"], how).drop("_salt")


def top(df: DataFrame, by: list[str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; Spark limits each partition's groups before it shuffles."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def latest(df: DataFrame, by: str, version: str) -> DataFrame:
    return top(df, [by], [F.desc(version)], 1)


#: Rows in a run of a page index, on average.
RUN_ROWS = 500_000


class PageIndex:
    """Rows parted into runs by ranges of an order, with each run's number of rows: a page reads the runs that it lies in."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self.spark, self.order, self.columns = df.sparkSession, order, df.columns
        self.path = fresh_path(self.spark, "pages")
        STAGED.append(self.path)
        runs = max(1, -(-df.count() // RUN_ROWS))
        df.repartitionByRange(runs, *order).withColumn("_run", F.spark_partition_id()).write.partitionBy("_run").parquet(self.path)
        rows = self._rows(df.schema)
        self.counts = [(r["_run"], r["count"]) for r in rows.groupBy("_run").count().orderBy("_run").collect()]  # one row a run
        self.schema, self.total = df.schema, sum(n for _, n in self.counts)

    def _rows(self, schema) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields, StructField("_run", IntegerType())])).parquet(self.path)

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1), in order; what lies beyond the end is empty."""
        first, last, before, runs = (number - 1) * size, number * size, 0, []
        for run, n in self.counts:
            if before < last and before + n > first:
                runs.append((run, before))
            before += n
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/_run={r}" for r, _ in runs)).orderBy(*self.order)
        return rows.offset(max(first - runs[0][1], 0)).limit(size).select(*self.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of an index made for it alone; keep a PageIndex for more than one."""
    return PageIndex(df, order).page(number, size)


def within_budget(df: DataFrame, by: list[str], order: list[Column | str], cost: str, rows: int, budget: int) -> DataFrame:
    """The leading rows of each group, at most `rows`, before their summed cost first passes `budget`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_sum", F.sum(cost).over(w))
    return seen.where((F.col("_n") <= rows) & (F.col("_sum") <= budget)).drop("_n", "_sum")
