"""Collocations by hierarchical pair naming.

The corpus is held as blocks of positions, each with the id of its word, if the word is frequent. Two grams of k-1 frequent
words that start at adjacent positions make one of k words. Level by level, such pairs are counted over the whole corpus where
both may be frequent, and the frequent ones are named by their words' ids.

A gram's pair of names are its parents: the gram without its last and that without its first word. They lead to the counts of
all its cuts, and to what it may subsume: if a longer candidate holds a phrase and is nearly as frequent, then so is the one
that is longer by a single word, whose parent the phrase is.

Blocks name words by local numbers, and send only a block's distinct grams, not its positions. Which grams are frequent they
learn from a sieve (a Bloom filter of bounded size) and not from a join of each block's grams: it lets all frequent grams pass,
and a few others, whose extensions are counted and dropped, so the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, broadcast_checked, by_bytes, release, salted_join, staged, table

#: Positions in a block, and those that a task holds for all languages until it closes their blocks.
BLOCK_WORDS, HELD_WORDS = 1 << 20, 3 << 20
#: Bytes of text that are split into words at once, and grams that leave a task at once.
SLICE_BYTES, SENT_GRAMS = 2 << 20, 1 << 16
#: Rows of one parent beyond which they are dealt to several tasks of a join, and frequent words up to which they are broadcast.
HOT_ROWS, BROADCAST_ROWS = 200_000, 500_000
#: Frequent grams for each 64-bit word of a sieve, and its most words (32 MB); beyond them it lets more grams pass.
SIEVE_GRAMS, SIEVE_WORDS = 4, 1 << 22
#: Fixed by the contract: A-Z is folded, the marks and line ends part pieces (here all become full stops), tabs part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
BLOCKS = "block long, lang string, own int, n_words long, ids binary, size int, names array<long>"


def slices(folded: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes that end before a space or a full stop, so that no word is cut."""
    start = 0
    while len(folded) - start > size:
        ends = [e for e in (folded.find(b" ", start + size), folded.find(b".", start + size)) if e >= 0]
        if not ends:
            break
        yield folded[start : min(ends)]
        start = min(ends)
    yield folded[start:]


def packed(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype("<u4").tobytes(), "zstd", asbytes=True)


def unpacked(ids: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, 4 * size, "zstd", asbytes=True), "<u4").astype(np.int64)


def word_blocks(texts: DataFrame, carry: int) -> DataFrame:
    """Blocks of one language's word positions in any order of texts, with the block's words and how often it owns each.

    A full stop stands between pieces and texts (local number 0). A block owns all its positions but the last `carry`
    ones, which the next block of its task starts with; so phrases that cross a block's end are whole in the one that owns
    their start.
    """
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        counts: dict[str, int] = {}
        number, task = 0, TaskContext.get().partitionId()

        def close(lang: str, last: bool) -> pa.RecordBatch:
            nonlocal number
            words = pa.concat_arrays(held[lang])
            own = len(words) if last else max(len(words) - carry, 0)
            held[lang] = [words[own:]]
            counts[lang] = len(words) - own
            coded = words.dictionary_encode()
            names = coded.dictionary
            stop = pa.compute.index(names, pa.scalar(b".", names.type)).as_py()
            ids = coded.indices.to_numpy().astype(np.int64) + 1
            n = np.bincount(ids[:own], minlength=len(names) + 1)[1:]
            if stop >= 0:
                ids[ids == stop + 1] = 0
                n[stop] = 0
            number += 1
            row = [[task << 33 | number], [lang], [own], [int(n.sum())], [packed(ids)], [len(ids)]]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            ends = pa.array([0, len(names)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, names.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(n))]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(row, kinds)), *lists], names=["block", "lang", "own", "n_words", "ids", "size", "words", "counts"])

        def put(lang: str, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
            for part in slices(b".".join([*raw, b""]), SLICE_BYTES):
                words = pa.array(part.replace(b".", b" . ").split(), pa.binary())
                held.setdefault(lang, []).append(words)
                counts[lang] = counts.get(lang, 0) + len(words)
                if counts[lang] >= BLOCK_WORDS:
                    yield close(lang, False)

        for batch in batches:
            texts, langs = batch.column("raw").to_pylist(), batch.column("lang").to_pylist()
            for a, b in by_bytes(map(len, texts), SLICE_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, raw in zip(langs[a:b], texts[a:b]):
                    by_lang.setdefault(lang, []).append(raw.translate(FOLD))
                for lang, raw in by_lang.items():
                    yield from put(lang, raw)
            if sum(counts.values()) > HELD_WORDS:
                for lang in [x for x in held if counts[x]]:
                    yield close(lang, True)
                    del held[lang], counts[lang]
        for lang in [x for x in held if counts[x]]:
            yield close(lang, True)

    return texts.mapInArrow(run, "block long, lang string, own int, n_words long, ids binary, size int, words array<string>, counts array<long>")


def sieve_places(grams: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a sieve, and the four bits in it, of each gram; `grams` has an array of word ids for each place in the gram."""
    h = np.zeros(len(grams[0]), np.uint64)
    for ids in grams:
        h = (h ^ ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    bits = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64), bits


def sieve(named: DataFrame, k: int) -> Broadcast:
    """A Bloom filter of the grams of k words in `named` (id), broadcast; the driver gets its words, at most SIEVE_WORDS."""
    size = min(named.count() // SIEVE_GRAMS + 1, SIEVE_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = sieve_places([c.to_numpy() for c in batch.columns], size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = named.select(*(F.col("id")[i].alias(f"w{i}") for i in range(k))).mapInArrow(run, "at long, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return named.sparkSession.sparkContext.broadcast(words)


def words_of(blocks: DataFrame) -> DataFrame:
    """(block, lang, code, word, n) of each distinct word of a block; code is its local number."""
    found = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    return found.select("block", "lang", (F.col("at") + 1).cast("long").alias("code"), F.col("w.words").alias("word"), F.col("w.counts").alias("n")).where("word <> '.'")


def grams_of(blocks: DataFrame, k: int, seen: Broadcast | None) -> DataFrame:
    """(w0, w1, ..., n) of each distinct gram of k frequent words that a block owns, whose two parts of k-1 words pass the sieve
    `seen`, if there is one: its words' ids, and how often the block owns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, size, ids = (batch.column(c)[row].as_py() for c in ("own", "size", "ids"))
                if size < k:
                    continue
                ids = unpacked(ids, size)
                names = np.concatenate([[0], batch.column("names")[row].values.to_numpy()])
                parts = np.lib.stride_tricks.sliding_window_view(ids, k - 1).all(axis=1)
                if seen is not None:
                    at = np.flatnonzero(parts)
                    place, bits = sieve_places([names[ids[at + i]] for i in range(k - 1)], len(seen.value))
                    parts[at] = seen.value[place] & bits == bits
                at = np.flatnonzero(parts[:-1] & parts[1:])
                at = at[at < own]
                which = ids[at]
                for i in range(1, k):  # a local number for each distinct gram of i + 1 words
                    which = np.unique(which << 32 | ids[at + i], return_inverse=True)[1]
                n = np.bincount(which)
                first = np.empty(len(n), np.int64)
                first[which] = at
                for i in range(0, len(n), SENT_GRAMS):
                    part = first[i : i + SENT_GRAMS]
                    yield pa.RecordBatch.from_arrays([*(pa.array(names[ids[part + j]]) for j in range(k)), pa.array(n[i : i + SENT_GRAMS])], names=[*(f"w{j}" for j in range(k)), "n"])

    return blocks.select("own", "size", "ids", "names").mapInArrow(run, ", ".join([*(f"w{i} long" for i in range(k)), "n long"]))


def renamed(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """`blocks` with each position's word replaced by the id that `found` (block, code, id) has for it, or by none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a block without a frequent word ends here
            return EMPTY
        row = {c: left.column(c)[0].as_py() for c in ("block", "lang", "own", "n_words", "ids", "size")}
        ids = unpacked(row["ids"], row["size"])
        known, names = right.column("code").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(known)
        known, names = known[order], names[order]
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        row["ids"] = packed(np.where(known[at] == ids, at + 1, 0))
        names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(names))
        return pa.table({**{c: pa.array([row[c]], EMPTY.schema.field(c).type) for c in EMPTY.column_names[:-1]}, "names": names})

    sides = blocks.select("block", "lang", "own", "n_words", "ids", "size"), found.select(F.col("block").alias("at"), "code", "id")
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("at")).applyInArrow(run, BLOCKS)


EMPTY = pa.table({"block": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "own": pa.array([], pa.int32()), "n_words": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "size": pa.array([], pa.int32()), "names": pa.array([], pa.list_(pa.int64()))})


def with_ids(counted: DataFrame) -> DataFrame:
    """Frequent words numbered from 1: their places in the files that they are written to, after those in the files before."""
    rows = staged(counted.withColumn("place", F.monotonically_increasing_id()))
    file = F.shiftrightunsigned("place", 33)
    before, total = [], 1
    for r in rows.groupBy(file.alias("file")).count().orderBy("file").collect():  # one row a file
        before.append((r["file"], total - (r["file"] << 33)))
        total += r["count"]
    shift = F.broadcast(counted.sparkSession.createDataFrame(before, "file long, shift long"))
    return rows.withColumn("file", file).join(shift, "file").withColumn("id", F.col("place") + F.col("shift")).drop("file", "place", "shift")


def pair_grams(named: DataFrame, parents: DataFrame) -> DataFrame:
    """The grams of `named` (id, left, right, f) with what their parents know: text, language, counts of first and last words."""
    first = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("heads", F.array("f")).alias("heads"))
    second = parents.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
    out = salted_join(salted_join(named, first, "left", "right", HOT_ROWS), second, "right", "left", HOT_ROWS)
    return out.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "left", "right", "heads", "tails")


def levels(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Word occurrences by language, and the frequent grams of 1 to `longest` words, each level staged."""
    blocks = staged(word_blocks(texts, longest - 1), compression="zstd")
    totals = staged(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    named = with_ids(words_of(blocks).groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    nothing = F.array().cast("array<long>")
    null = F.lit(None).cast("array<long>")
    grams = [named.select(F.array("id").alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", null.alias("left"), null.alias("right"), nothing.alias("heads"), nothing.alias("tails"))]
    found = words_of(blocks).join(broadcast_checked(named, BROADCAST_ROWS), ["lang", "word"]).select("block", "code", "id")
    before, blocks = blocks, staged(renamed(blocks, found), compression="zstd")
    release(before)
    seen = None
    for k in range(2, longest + 1):
        words = [f"w{i}" for i in range(k)]
        counted = grams_of(blocks, k, seen).groupBy(*words).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counted = staged(counted.select(F.array(*words).alias("id"), F.array(*words[:-1]).alias("left"), F.array(*words[1:]).alias("right"), "f"))
        grams.append(staged(pair_grams(counted, grams[-1])))
        if seen is not None:
            seen.destroy()
        seen = sieve(counted, k) if k < longest else None
        release(counted)
    release(blocks)
    return totals, grams


WIDE = "CAST({} AS DECIMAL(20, 0))".format


def worst_cut(scale: int) -> str:
    """The cut of a gram (f, heads, tails) with the lowest score, and the shortest first part, as (score, k, l, r)."""
    return f"""array_min(transform(sequence(1, size(heads)), k -> named_struct(
        'score', (CAST({scale} AS DECIMAL(10, 0)) * {WIDE('f')}) div ({WIDE('heads[k - 1]')} + {WIDE('tails[size(heads) - k]')}),
        'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k])))"""


def mine(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words from `docs` (lang, text).

    A phrase is frequent if it occurs `least` times within pieces, overlaps included. Its score is floor(scale * a / (l + r)) at its worst
    cut. Phrases inside a longer frequent one with percent of their occurrences are dropped. Ranks follow score, a and the
    phrase's bytes, so there are no ties. A null text is empty, a null language `und`; a repeated row counts again; other
    columns don't matter; a language without a frequent phrase, and an empty table, give no rows. Counts are 64 bits wide, products
    are decimals.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    totals, grams = levels(texts, longest, least)
    longer = [g.select(F.col(side).alias("id"), "f") for g in grams[2:] for side in ("left", "right")]
    phrases = grams[1]
    for g in grams[2:]:
        phrases = phrases.union(g)
    if longer:
        holders = longer[0]
        for x in longer[1:]:
            holders = holders.union(x)
        holders = holders.groupBy("id").agg(F.max("f").alias("most"))
        phrases = phrases.join(holders, "id", "left").where(F.expr(f"most IS NULL OR {WIDE('most')} * 100 < {WIDE('f')} * {percent}"))
    scored = phrases.select("lang", "phrase", F.col("f").alias("a"), F.expr(worst_cut(scale)).alias("cut"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}
SQL = {
    "op13_collocations": r"""
WITH low AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM low)),
     runs AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) t(k) WHERE len(w) >= k)),
     f AS (SELECT lang, array_to_string(g, ' ') AS g, k, count(*)::BIGINT AS f FROM runs GROUP BY ALL),
     n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
     often AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
     cand AS (SELECT lang, g, f AS a, k, regexp_extract_all(g, '[^\x20]+') AS w FROM often WHERE k > 1),
     cuts AS (SELECT lang, g, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
     scores AS (SELECT c.lang, c.g, a, j, p.f AS l, q.f AS r, (2000000::HUGEINT * a) // (p.f::HUGEINT + q.f) AS score
                FROM cuts c JOIN often p ON p.lang = c.lang AND p.g = c.head JOIN often q ON q.lang = c.lang AND q.g = c.tail),
     worst AS (SELECT lang, g AS phrase, any_value(a) AS a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM scores GROUP BY lang, g),
     inside AS (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))),
     holders AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
     stay AS (SELECT w.* FROM worst w LEFT JOIN holders h USING (lang, phrase) WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * w.a),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
}
