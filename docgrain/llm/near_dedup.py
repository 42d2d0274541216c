"""Near-duplicate components by min-max hashing.

Under each of 64 permutations both the minimum and the maximum of a document's shingle hashes are kept: 128 unbiased
signature values from 64 evaluations a shingle. 32 bands of four values make candidates; every candidate is confirmed
on the full shingle sets.

Documents with equal sets are one class, and classes are what is linked. Links are found in two steps, neither of which
emits the pairs within a bucket. First each member of a bucket is compared with the bucket's class of the smallest doc_id. Where that
leaves a bucket with members of several components, its members meet again by their rarest shingles: two sets that are
75 percent alike share one of the rarest quarter of either, so texts that share a template and nothing else never meet.
Of the members that hold a rare shingle, those outside its largest component are compared with the others across
components; such members are split by ranges of set sizes, and many into the cells of a grid, so that their comparisons are
dealt to many tasks. All sets order their shingles alike, so two sets share nothing before the first shingle by which they meet: a
pair goes on from a shingle only if both sets hold enough shingles from there on, which most near copies of one text that aren't
alike themselves fail. Only pairs whose sizes and sketches allow the similarity reach confirmation, those of this step by sketches of
1024 further permutations too: the sketch bounds lie five standard deviations or more beyond the threshold. Joins on a class
that many others link to, or on a label that many share, are salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import STAGED, bounded_batches, broadcast_checked, one_of_twins, release, salted, salted_join, staged, table, text_digest, text_runs, without

WORDS = 5
PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Differing sketch bits of 256 up to which a pair is confirmed (at 75 percent a pair differs in 32 on average, give or take 6).
SKETCH_BITS = 72
#: The same for the finer sketches of 4096 bits (512 on average, give or take 25).
FINE, FINE_BITS = 1024, 640
#: Rows of one key beyond which a join deals them to several tasks: of whole sets, and of narrow rows.
HOT_SETS, HOT_ROWS = 2_000, 200_000
#: Side of a grid cell in which the members that hold one rare shingle are compared.
CELL = 2_000
#: Bits of a shingle's counter; rarer ones come first. The table of counters has one size whatever the input, and what meets
#: doesn't depend on it: any order that is the same for all sets finds every link.
COUNTER_BITS = 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def factors(n: int, seed: int) -> np.ndarray:
    """Odd multipliers: each permutes 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = factors(PERMUTATIONS, 5)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: folds A-Z and splits at ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * MULTIPLIER + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


def signature(hashes: np.ndarray, by: np.ndarray = _FACTORS) -> np.ndarray:
    """Minima, then maxima, under each permutation."""
    low, high = np.full(len(by), ~np.uint64(0)), np.zeros(len(by), np.uint64)
    step = max(1, (1 << 17) // len(by))
    for a in range(0, len(hashes), step):
        h = hashes[a : a + step, None] * by
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        keys = mixed(keys * MULTIPLIER + column)
    return keys.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each signature value."""
    bits = np.concatenate([values >> np.uint64(20) & np.uint64(1), values >> np.uint64(21) & np.uint64(1)]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_shingles, digest, bands, sketch) of each row: `own` is the text's digest, `digest` the set's; no digest,
    bands or sketch for an empty set."""
    import xxhash

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            sizes, digests, bands, sketches = [], [], [], []
            for text in texts:
                found = shingles(text)
                sizes.append(len(found))
                values = signature(found) if len(found) else None
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(values) if len(found) else None)
                sketches.append(sketch(values) if len(found) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("own"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                names=["doc_id", "own", "n_shingles", "digest", "bands", "sketch"],
            )

    texts = docs.select("doc_id", "text", text_digest(docs["text"]).alias("own"))
    return texts.mapInArrow(run, "doc_id long, own string, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def whole_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """The staged sets (vid, hashes) of those of `classes` (vid, rep, digest) that are in `ids` (vid), read from a document with
    the representative's id; of several texts under that id the one whose set has the class's digest."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            sets = [shingles(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["digest", "hashes"])

    wanted = staged(classes.select("vid", "rep", "digest").join(broadcast_checked(staged(ids.distinct())), "vid", "left_semi"))
    reps = broadcast_checked(staged(wanted.select("rep").distinct()))
    chosen = docs.select("doc_id", "text").join(reps, docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi")
    found = chosen.mapInArrow(run, "digest binary, hashes binary")
    return staged(found.join(broadcast_checked(wanted.select("vid", "digest")), "digest").select("vid", "hashes").dropDuplicates(["vid"]))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def counters(sets: DataFrame) -> np.ndarray:
    """How often the sets (vid, hashes) hold a shingle of each counter; the driver gets a row for each counter at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for x in batch.column("hashes"):
                np.add.at(held, counter_of(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    held = np.zeros(1 << COUNTER_BITS, np.int64)
    found = sets.select("hashes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    held[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return held


def rarest(hashes: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
    """As many of a set's shingles, from the rarest on, as it can't all lack in common with a set that is alike."""
    return hashes[np.lexsort((hashes, held[counter_of(hashes)]))[: len(hashes) + 1 - -(-percent * len(hashes) // 100)]]


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(vid, key, at): a row for each of the rarest shingles of the sets (vid, hashes), and how many rarer ones its set has."""
    held = counters(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rarest(np.frombuffer(x.as_buffer(), np.uint64), held, percent) for x in batch.column("hashes")]
            vids = np.repeat(batch.column("vid").to_numpy(), [len(x) for x in found])
            keys, at = (np.concatenate(found).view(np.int64), np.concatenate([np.arange(len(x)) for x in found])) if found else (vids, vids)
            yield pa.RecordBatch.from_arrays([pa.array(vids), pa.array(keys), pa.array(at)], names=["vid", "key", "at"])

    return sets.select("vid", "hashes").mapInArrow(run, "vid long, key long, at long")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(vid, fine) of the sets (vid, hashes)."""
    by = factors(FINE, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(signature(np.frombuffer(x.as_buffer(), np.uint64), by)) for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(found, pa.list_(pa.int64()))], names=["vid", "fine"])

    return sets.select("vid", "hashes").mapInArrow(run, "vid long, fine array<long>")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets (vid, hashes) have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs, x, on_a = salted(pairs, sets.toDF("a", "x"), "a", "b", HOT_SETS)
    pairs, y, on_b = salted(pairs, sets.toDF("b", "y"), "b", "a", HOT_SETS)
    return pairs.join(x, on_a).join(y, on_b).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike(percent: int) -> Column:
    """What sizes and sketches of a pair (n, s and n2, s2) allow."""
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (differing("s", "s2", PERMUTATIONS // 16) <= allowed(SKETCH_BITS, 256, percent))


def reachable(n: str, at: str, n2: str | Column, percent: int) -> Column:
    """Whether a set of n shingles can be alike to one of n2 if the first shingle that they share comes after `at` others of its own."""
    return (F.col(n) - F.col(at)) * (100 + percent) >= percent * (F.col(n) + (F.col(n2) if isinstance(n2, str) else n2))


def size_class(n: str, percent: int) -> Column:
    """Sets that are alike have the same class or neighbouring ones."""
    return F.floor(F.ln(n) / (math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col(n)


def classes_met(percent: int) -> Column:
    """The size classes of the sets that one of `n` shingles and class `size` can be alike to from place `at` on."""

    def least(c: Column) -> Column:  # no set of the class is smaller; one less than its bound, for rounding
        return F.floor(F.exp(c * (math.log(100 / percent) + 1e-9))) - 1 if percent < 100 else c

    return F.filter(F.array(*(F.col("size") + d for d in (-1, 0, 1))), lambda c: reachable("n", "at", least(c), percent))


def differing(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, longs)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def allowed(bits: int, of: int, percent: int) -> int:
    """The bound for 75 percent moved to another threshold; looser ones for lower thresholds."""
    return bits if percent == 75 else round((1 - percent / 100) * of / 2 + max(bits - of / 8, 0) * 1.3)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vid, label) of every vertex of the undirected edges (a, b): the smallest id reachable, or after a number of
    rounds some id that is reachable.

    Labels fall to the neighbours' minimum and then to their label's own label, so a path shrinks by half a round; each
    round is staged.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "vid"))
    while rounds != 0:
        near = salted_join(both, labels.toDF("b", "l"), "b", "a", HOT_ROWS).groupBy("a").agg(F.min("l").alias("l"))
        lower = staged(labels.join(near, labels.vid == near.a).select("vid", F.least("label", "l").alias("hop"), F.col("label").alias("old")))
        jump = salted_join(lower, labels.toDF("hop", "jump"), "hop", "vid", HOT_ROWS, "left")
        new = staged(jump.select("vid", F.least("hop", F.coalesce("jump", "hop")).alias("label"), "old"))
        release(lower)
        labels = new.select("vid", "label")
        if rounds:
            rounds -= 1
        elif new.where("label <> old").isEmpty():
            break
    return labels


def largest(labelled: DataFrame) -> DataFrame:
    """(key, main): the label that most rows (key, vid, label) of a key have, of keys with several labels."""
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    return counted.groupBy("key").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").select("key", "main")


def compared(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """`left` (key, sizes, a, ...) joined with `right` (key, size, b, ...) on key and each of its sizes, where `condition` holds.

    The rows of a key and size are counted on both sides; where they fill more than a grid cell, each side is dealt into
    parts and copied to the other's parts, so that every pair meets in one cell.
    """
    left = left.withColumn("size", F.explode("sizes")).drop("sizes")
    n = left.groupBy("key", "size").agg(F.count("*").alias("n")).join(right.groupBy("key", "size").agg(F.count("*").alias("m")), ["key", "size"])
    hot = staged(n.where((F.col("n") > CELL) | (F.col("m") > CELL)).select("key", "size", F.ceil(F.col("n") / CELL).cast("int").alias("down"), F.ceil(F.col("m") / CELL).cast("int").alias("across")))
    on = ["key", "size"]
    if not hot.isEmpty():
        hot, on = broadcast_checked(hot), [*on, "r", "c"]
        down, across = F.coalesce("down", F.lit(1)), F.coalesce("across", F.lit(1))
        left = left.join(hot, ["key", "size"], "left").withColumn("r", F.pmod(F.xxhash64("a"), down).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), across - 1))).drop("down", "across")
        right = right.join(hot, ["key", "size"], "left").withColumn("c", F.pmod(F.xxhash64("b"), across).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), down - 1))).drop("down", "across")
    return left.alias("left").join(right.alias("right"), on).where(condition).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when their sets of distinct 5-word shingles (words as ASCII blanks part them, A-Z folded) have
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. A document without words is its
    own component. A row with a null id links like any other; its component_id is null if no row with an id is reachable.
    One id with several texts is linked by each of them. Repeated rows share a component. `kept` says that doc_id and
    component_id are the same (nulls too). Other columns don't matter; an empty table gives no rows.
    """
    return decided(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def decided(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of `near_duplicates` with `own` (the text's digest) and `label` (the component; null for an empty set)."""
    before = set(map(id, STAGED))
    sigs = staged(signatures(docs))
    longest = sigs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("s"), F.first("bands").alias("bands"))
    classes = staged(longest.withColumn("vid", F.monotonically_increasing_id()))
    keyed = classes.select("vid", "rep", F.explode("bands").alias("key"))
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "vid"))["vid"]  # the earliest document, from which copies were made
    buckets = keyed.groupBy("key").agg(first.alias("center"), F.count("*").alias("n")).where("n > 1")
    members = staged(salted_join(keyed.select("vid", "key"), staged(buckets.select("key", "center")), "key", "vid", HOT_ROWS))
    heads = classes.select("vid", "n", "s")
    star = staged(members.where("vid <> center").select(F.col("vid").alias("a"), F.col("center").alias("b")).distinct())
    pairs, centers, on = salted(star, heads.toDF("b", "n2", "s2"), "b", "a", HOT_ROWS)
    star = pairs.join(heads.withColumnRenamed("vid", "a"), "a").join(centers, on).where(alike(percent)).select("a", "b")
    star = staged(star)
    edges = staged(confirmed(whole_sets(docs, classes, star.select(F.explode(F.array("a", "b")).alias("vid"))), star, percent))
    label = components(edges, rounds=2)  # equal labels are one component; unequal ones may be, and are then compared

    # The members of buckets that still hold several components meet by their rarest shingles.
    labelled = members.join(label, "vid", "left").select("key", "vid", F.coalesce("label", "vid").alias("label"))
    mixed_in = staged(salted_join(labelled, staged(largest(labelled)), "key", "vid", HOT_ROWS).select("vid", "label").distinct())
    sets = whole_sets(docs, classes, mixed_in.select("vid"))
    rare = staged(rare_keys(sets, percent).join(mixed_in, "vid"))
    rare = staged(salted_join(rare, staged(largest(rare)), "key", "vid", HOT_ROWS))
    rare = salted_join(rare, staged(heads.join(mixed_in, "vid", "left_semi").select("vid", "n", "s", size_class("n", percent).alias("size"))), "vid", "key", HOT_ROWS)
    left = rare.where("label <> main").select("key", classes_met(percent).alias("sizes"), F.col("vid").alias("a"), F.col("label").alias("la"), "main", "n", "s", F.col("at").alias("i"))
    right = rare.select("key", "size", F.col("vid").alias("b"), F.col("label").alias("lb"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("at").alias("j"))
    # Of two members outside the largest component, one order is enough.
    new = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
    new = new & reachable("n", "i", "n2", percent) & reachable("n2", "j", "n", percent) & alike(percent)
    rest = staged(compared(left, right, new).distinct())
    if not rest.isEmpty():
        fine = staged(fine_sketches(sets))
        pairs, f, on_a = salted(rest, fine.toDF("a", "f"), "a", "b", HOT_ROWS)
        pairs, f2, on_b = salted(pairs, fine.toDF("b", "f2"), "b", "a", HOT_ROWS)
        near = pairs.join(f, on_a).join(f2, on_b).where(differing("f", "f2", FINE // 16) <= allowed(FINE_BITS, 4096, percent)).select("a", "b")
        edges = edges.union(confirmed(sets, staged(near), percent))
    label = components(edges)
    linked = staged(label.join(classes.select("vid", "rep"), "vid"))
    smallest = staged(linked.groupBy("label").agg(F.min("rep").alias("component_id")))
    linked = salted_join(linked.select("vid", "label"), smallest, "label", "vid", HOT_ROWS)
    by_class = classes.select("vid", "digest", "rep").join(linked, "vid", "left")
    by_class = staged(by_class.select("digest", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "vid").alias("label")))
    release(*(x for x in list(STAGED) if id(x) not in before and x is not sigs and x is not by_class))
    rows = sigs.select("doc_id", "own", "n_shingles", "digest")
    full = salted_join(rows.where("digest IS NOT NULL"), by_class, "digest", "own", HOT_ROWS).select("doc_id", "own", "n_shingles", "component_id", "label")
    # Empty sets don't meet in a join.
    alone = rows.where("digest IS NULL").select("doc_id", "own", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return full.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component of `docs`: its smallest id's; of several texts under that id the first by digest, of equal rows the first.

    A row is told by its id and its text, so a different text under the same id is judged by itself. Documents without words stay.
    """
    found = staged(decided(docs, percent))
    winners = found.where("kept AND label IS NOT NULL").groupBy("label", "doc_id", F.col("own").alias("digest")).agg(F.count("*").alias("rows"))
    first = staged(winners.groupBy("label").agg(F.min(F.struct("digest", "doc_id", "rows")).alias("w")).select("label", "w.*"))
    second = winners.join(first.select("label", F.col("digest").alias("best")), "label").where(F.col("digest") > F.col("best"))
    lost = found.where("NOT kept").select("doc_id", F.col("own").alias("digest"))
    stay = without(docs, lost.union(second.select("doc_id", "digest")))
    return one_of_twins(stay, first.where("rows > 1"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
