"""Importance resampling toward a target distribution over hashed n-grams.

Long texts are cut into chunks at word boundaries. A chunk owns the starting positions of its own words and carries the
n-1 words after them, so that each run of words is counted once, in the chunk where it starts; chunks of long texts are dealt to
all tasks. Chunk counts and weights are summed by document.

Buckets of features are counted over all documents and over the target's texts; a bucket's gain is the logarithm of the
ratio of the two smoothed shares. A document's weight is the sum of its features' gains; a Gumbel draw that follows from
its id is added, and the documents with the highest scores are drawn, which is sampling without replacement in proportion to
the weights' exponentials. Ranks come from range-partitioned runs and the counts of the runs before them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, by_bytes, release, staged, table

#: Bytes of text above which a text is cut, and about which its chunks have.
CHUNK_BYTES = 1 << 18
#: Features whose buckets a worker remembers.
REMEMBERED = 1 << 18
#: Rows in a run of the score order, on average.
RUN_ROWS = 100_000
#: Fixed by the contract: what lies between words (upper case is folded, so only a-z, 0-9 and what isn't ASCII are words).
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
FEATURES = "doc_id long, digest binary, part long, words long, n_features long, buckets binary"
WEIGHTS = "doc_id long, digest binary, part long, words long, n_features long, weight long"


@lru_cache(REMEMBERED)
def hashed(feature: bytes) -> int:
    return zlib.crc32(feature)


def cut(folded: bytes, size: int, carry: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, own) of each chunk of a folded text: about `size` bytes of its own words, then up to `carry` words of what follows."""
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + size) if start + size < len(folded) else -1
        end = len(folded) if end < 0 else end
        words = folded[start:end].split()
        own, ahead, at = len(words), 0, end
        while ahead < carry and at < len(folded):
            while at < len(folded) and folded[at] == 32:
                at += 1
            stop = folded.find(b" ", at)
            stop = len(folded) if stop < 0 else stop
            if stop > at:
                words.append(folded[at:stop])
                ahead += 1
            at = stop
        if own:
            yield words, own
        start = end


def buckets_of(words: list[bytes], own: int, n: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to n words that starts among the first `own` ones."""
    found = [hashed(w) for w in words[:own]]
    for k in range(2, n + 1):
        found += [hashed(b" ".join(words[i : i + k])) for i in range(min(own, len(words) - k + 1))]
    return (np.array(found, np.uint32) % np.uint32(buckets)).astype(np.uint32)


def held_as(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """A row per text (doc_id, text), or per chunk of a long one: words and features that start there, and their buckets.
    Chunks of one text share `digest` and count from 0 in `part`; other texts have no digest.
    """
    bounded_batches(texts.sparkSession)
    held = held_as(buckets)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in FEATURES.split(", ")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                words = (raw or b"").translate(FOLD).split()
                found = buckets_of(words, len(words), n, buckets)
                out.append((doc, None, 0, len(words), len(found), found.astype(held).tobytes()))
            if out:
                yield rows(out)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, digest, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "raw"))):
                empty = True
                for part, (words, own) in enumerate(cut(raw.translate(FOLD), CHUNK_BYTES, n - 1)):
                    empty = False
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "digest": pa.array([digest], pa.binary()), "part": pa.array([part], pa.int64()), "own": pa.array([own], pa.int64()), "raw": pa.array([b" ".join(words)], pa.binary())})
                if empty:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "digest": pa.array([digest], pa.binary()), "part": pa.array([0], pa.int64()), "own": pa.array([0], pa.int64()), "raw": pa.array([b""], pa.binary())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, digest, part, own, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "part", "own", "raw"))):
                found = buckets_of(raw.split(b" ") if raw else [], own, n, buckets)
                out.append((doc, digest, part, own, len(found), found.astype(held).tobytes()))
            if out:
                yield rows(out)

    raw, size = F.col("text").cast("binary").alias("raw"), F.coalesce(F.octet_length("text"), F.lit(0))
    short = texts.where(size <= CHUNK_BYTES).select("doc_id", raw).mapInArrow(whole, FEATURES)
    long = texts.where(size > CHUNK_BYTES).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), raw)
    long = long.mapInArrow(chunks, "doc_id long, digest binary, part long, own long, raw binary").repartition("digest", "part")
    return short.union(long.mapInArrow(parts, FEATURES))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; the driver gets one row for each bucket at most."""
    held = held_as(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for a, b in by_bytes(map(len, values), 4 << 20):
                seen += np.bincount(np.frombuffer(b"".join(values[a:b]), held), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    t_all, s_all, size = int(target.sum()), int(corpus.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + size)) / ((s + 1) * (t_all + size)))) for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weighed(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight): one row for each text; those of chunks are summed by document."""
    held = held_as(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[np.frombuffer(b, held)].sum()) for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "part", "words", "n_features")), pa.array(weight, pa.int64())], names=[c.split()[0] for c in WEIGHTS.split(", ")])

    parts = found.mapInArrow(run, WEIGHTS)
    names = ["words", "n_features", "weight"]
    # A text repeated under its id is that many rows again: their chunks' sums are its own as many times.
    sums = parts.where("digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.count_if(F.col("part") == 0).alias("rows"), *(F.sum(c).alias(c) for c in names))
    long = sums.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in names), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")
    return parts.where("digest IS NULL").select("doc_id", *names).union(long)


def gumbel(seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))), with u in (0, 1) from the sha256 of the seed and the document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, drawn: int, order: list[Column]) -> DataFrame:
    """`scored` (staged) with `rank`: 1 to `drawn` in `order`, null for the others.

    The rows are parted by ranges of the order, each numbered by itself; how many rows stand before a range is a sum over
    counts, of which there is one a range. Ranges beyond the last drawn row aren't numbered.
    """
    rows = scored.count()
    runs = staged(scored.repartitionByRange(max(1, math.ceil(rows / RUN_ROWS)), *order).withColumn("run", F.spark_partition_id()))
    before, first = {}, 0
    for r in runs.groupBy("run").count().orderBy("run").collect():  # one row a range
        before[r["run"]], first = first, first + r["count"]
    near = [r for r, n in before.items() if n < drawn]
    if not near:
        return runs.drop("run").withColumn("rank", F.lit(None).cast("long"))
    offsets = F.broadcast(scored.sparkSession.createDataFrame([(r, before[r]) for r in near], "run int, before long"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order)) + F.col("before")
    numbered = runs.join(offsets, "run").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = runs.where(F.col("run") > max(near)).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(*scored.columns, "rank").union(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of `docs` (doc_id, text); rank counts the drawn ones from 1.

    `target` is a table with a column text. A null or empty text, or one without words, has no features and weight 0; an
    empty target is a uniform one. Only rows with at least `min_words` words may be drawn, floor(percent * rows / 100) of them.
    Ties go to the smaller doc_id (a null id last), then to the row with more features; rows alike in all of these are
    interchangeable. A repeated row is a row of its own with the same score. A null id draws as the text `null`. Other
    columns don't matter; an empty table gives no rows.
    """
    found = staged(features(docs.select("doc_id", "text"), n, buckets), compression="zstd")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    gains = gains_of(bucket_counts(goal, buckets), bucket_counts(found, buckets))
    scored = staged(weighed(found, gains).withColumn("score", F.col("weight") + gumbel(seed)))
    release(found)
    may = F.col("words") >= min_words
    drawn = scored.where(may).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = ranked(scored.where(may), drawn, order)
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return chosen.select(*columns, "rank").union(rest.select(*columns, "rank"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_target_resampling": op11_target_resampling}
SQL = {
    "op11_target_resampling": r"""
WITH low AS (SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
             UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
     words AS (SELECT side, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM low),
     counted AS (SELECT side, id, word, count(*) AS c FROM words GROUP BY ALL),
     crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
     spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
     bytes AS (SELECT word, list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS b FROM spelled),
     coded AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
     sums AS (SELECT bucket, sum(c) FILTER (WHERE side = 0) AS s, sum(c) FILTER (WHERE side = 1) AS t FROM counted JOIN coded USING (word) GROUP BY bucket),
     alls AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums),
     gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, alls),
     weights AS (SELECT id AS doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
     scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                       coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                FROM documents LEFT JOIN weights USING (doc_id)),
     places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN p.rank <= 10 * p.n // 100 THEN p.rank END AS rank FROM scored s LEFT JOIN places p USING (doc_id)
"""
}
