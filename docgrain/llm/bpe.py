"""Byte-level BPE encoding and decoding by merge replay over the words of the whole corpus.

Texts become runs: the numbers of their words (matches of the pattern) in the run's own list of distinct words. The
lists' words go to buckets by a hash, where each distinct word is replayed, and the ids go back to the runs, which lay them
out by the numbers. Words and ids travel packed; the runs themselves stay in a bucketed table, so that only the ids move to
them. No dictionary is broadcast or held whole in one task.

In a replay the words lie end to end in one array of symbols. An inverted index leads from the rank of a
token pair to the positions that hold it. The merges are applied in rank order, each to all its positions at once, and
only the pairs of the touched neighbours are looked up again. A neighbour pair of lower rank is taken before the scan
goes on, and of several places in a word the leftmost is merged first, so that the result is that of encoding each word
alone.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import words
from ._shared import bounded_batches, per_process, shared_dir, table, text_runs
from .token_files import pack_ranks, unpack_ranks

#: No pair.
NONE = np.int32(2**31 - 1)
#: Distinct words, and words in all, at which a run ends; a longer document is a run of its own.
RUN_DISTINCT, RUN_WORDS = 300_000, 4 << 20
#: Bytes of text for a bucket of the table of runs and for one of words, and how many buckets there are before that counts.
TABLE_BYTES, TABLE_BUCKETS = 256 << 20, 1024
WORD_BYTES, WORD_BUCKETS = 4 << 30, 256
#: Bytes of words that a task replays together (a word that comes again later is replayed again).
REPLAY_BYTES = 8 << 20
#: Ids in one batch of the result.
BATCH_IDS = 1 << 19
#: A row is a bucket's words of a run, packed, or (in bucket DOCUMENTS) its documents.
DOCUMENTS = -1
RUNS = "run long, bucket int, sizes binary, data binary, docs array<long>, words array<long>, control binary, ranks binary"
COLUMNS = [c.split()[0] for c in RUNS.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need; the first byte says how many."""
    size = 1 if (most := int(numbers.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=COLUMNS)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file; a task reads the tokenizer's file, which every machine has."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = ((ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        table = np.fromiter(pairs, np.dtype("i8,i4"))
        table.sort(order="f0")
        self.keys, self.values = table["f0"].copy(), table["f1"].copy()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, as the ranks' own order of merges gives them; a word that is a token is that token."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, r in zip(words, whole) if r is None]
        replayed = iter(self.replay(rest) if rest else [])
        return [next(replayed) if r is None else np.array([r], np.int32) for r in whole]

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words])
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(symbols), np.cumsum(sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, NONE)
        held = np.flatnonzero(after >= 0)
        pair[held] = self.pair_ranks(symbols[held], symbols[after[held]])
        # The index: positions by rank, as slices of one sorted array, and those that merges add.
        order = held[np.argsort(pair[held], kind="stable")][: np.count_nonzero(pair < NONE)].astype(np.int32)
        del held
        found, starts = np.unique(pair[order], return_index=True)
        bounds = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))
        added: dict[int, list[int]] = {}
        heap = found.tolist()
        while heap:
            rank = heapq.heappop(heap)
            while heap and heap[0] == rank:
                heapq.heappop(heap)
            a, b = bounds.pop(rank, (0, 0))
            new = added.pop(rank, None)
            at = order[a:b] if new is None else np.unique(np.concatenate([order[a:b], np.array(new, np.int32)]))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                w = word[at]
                first = np.concatenate([[True], w[1:] != w[:-1]])
                if not first.all():
                    added[rank] = at[~first].tolist()
                    heapq.heappush(heap, rank)
                    at = at[first]
            gone = after[at]
            beyond = after[gone]
            symbols[at] = rank
            after[at] = beyond
            alive[gone] = False
            pair[gone] = NONE
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            pair[at] = NONE
            right = at[linked]
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([right, left])
            if len(touched):
                ranks = self.pair_ranks(symbols[touched], symbols[after[touched]])
                pair[touched] = ranks
                for p, r in zip(touched.tolist(), ranks.tolist()):
                    if r < NONE:
                        if r not in added:
                            added[r] = []
                            heapq.heappush(heap, r)
                        added[r].append(p)
        kept = np.flatnonzero(alive)
        return np.split(symbols[kept], np.searchsorted(kept, ends[:-1]))


class RunWords(dict):
    """Numbers of the words of each part between single spaces, as little-endian 32-bit bytes; a key lacks its space."""

    def __init__(self, pattern):
        super().__init__()
        self.find, self.numbers = pattern.findall, {}

    def of(self, text: str) -> bytes:
        numbers = self.numbers
        return b"".join([numbers.setdefault(w, len(numbers)).to_bytes(4, "little") for w in self.find(text)])

    def __missing__(self, part: str) -> bytes:
        found = self.of(" " + part)
        if len(part) <= 64:
            self[part] = found
        return found

    def text(self, text: str) -> bytes:
        head, *rest = words(text)
        return self.of(head) + b"".join(map(self.__getitem__, rest)) if rest else self.of(head)


def widths(docs: DataFrame) -> tuple[int, int]:
    """Buckets of the table of runs and of words, from the texts' bytes; the table has no more than the texts have partitions."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, min(docs.rdd.getNumPartitions(), max(TABLE_BUCKETS, -(-size // TABLE_BYTES)))), max(WORD_BUCKETS, -(-size // WORD_BYTES))


def split_runs(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Packed runs of documents (see RUNS): a row for each bucket's distinct words, and one of the documents' ids, words each,
    and the words as ranks by frequency, followed by the ranks of the listed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled, task, number = regex.compile(pattern), TaskContext.get().partitionId(), 0
        held, docs_in, codes, size = RunWords(compiled), [], [], 0

        def out() -> pa.RecordBatch:
            listed = [w.encode() for w in held.numbers]
            flat = np.frombuffer(b"".join(codes), "<u4")
            rank = np.empty(len(listed), np.uint32)
            rank[np.argsort(-np.bincount(flat, minlength=len(listed)), kind="stable")] = np.arange(len(listed), dtype=np.uint32)
            bucket = np.array([crc32(w) % buckets for w in listed], np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets), "right")
            key, rows, first = task << 33 | number, [], 0
            for b, end in enumerate(ends.tolist()):
                if end > first:
                    some = [listed[i] for i in order[first:end].tolist()]
                    rows.append((key, b, narrow(np.array([len(w) for w in some])), b"".join(some), None, None, None, None))
                first = end
            control, ranks = pack_ranks(np.concatenate([rank[flat], rank[order]]))
            rows.append((key, DOCUMENTS, None, None, docs_in, [len(c) // 4 for c in codes], control, ranks))
            return packed_rows(rows)

        for batch, texts in text_runs(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                codes.append(held.text(text))
                docs_in.append(doc)
                size += len(codes[-1]) // 4
                if size >= RUN_WORDS or len(held.numbers) >= RUN_DISTINCT:
                    yield out()
                    number, held, docs_in, codes, size = number + 1, RunWords(compiled), [], [], 0
        if docs_in:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def replayed(listed: DataFrame, path: str) -> DataFrame:
    """`listed` (the words' rows of RUNS) with ids in the place of the words: numbers of ids as sizes, the ids as data.

    The rows of a bucket are in one task, which replays the distinct words of REPLAY_BYTES at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = per_process(("replay", path), lambda: MergeReplay(load_ranks(path)))
        held: list[tuple] = []
        numbers: dict[bytes, int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids = replay.encode(list(numbers))
            lengths = np.array([len(x) for x in ids], np.int64)
            flat, starts = np.concatenate(ids), np.cumsum(lengths) - lengths
            rows = []
            for key, bucket, codes in held:
                rows.append((key, bucket, narrow(lengths[codes]), narrow(gathered(flat, starts, lengths, codes)[0]), None, None, None, None))
                if len(rows) == 64:
                    yield packed_rows(rows)
                    rows = []
            if rows:
                yield packed_rows(rows)

        for batch in batches:
            for key, bucket, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("run", "bucket", "sizes", "data"))):
                before = len(numbers)
                codes = np.array([numbers.setdefault(w, len(numbers)) for w in cut(data, wide(sizes))], np.int64)
                size += len(data) * (len(numbers) - before) // max(len(codes), 1)
                held.append((key, bucket, codes))
                if size >= REPLAY_BYTES:
                    yield from out()
                    held, numbers, size = [], {}, 0
        if held:
            yield from out()

    return listed.mapInArrow(run, RUNS)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of `flat` that `codes` name, end to end, and where each ends."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def laid_out(docs: pa.Array, sizes: np.ndarray, codes: np.ndarray, pieces: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of a run's documents: `codes` are the ranks of their words, then those of the words that `pieces` list."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    listed = codes[total:]
    lengths, starts = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
    flat, found = (np.concatenate([wide(p[i]) for p in pieces] or [np.zeros(0, np.int64)]) for i in (1, 0))
    lengths[listed], starts[listed] = found, np.cumsum(found) - found
    first = 0
    while first < len(sizes):  # documents of about BATCH_IDS words at a time
        begin = int(ends[first] - sizes[first])
        last = max(int(np.searchsorted(ends, begin + BATCH_IDS, "right")), first + 1)
        ids, word_ends = gathered(flat, starts, lengths, codes[begin : int(ends[last - 1])].astype(np.int64))
        bounds = np.concatenate([[0], word_ends])[np.concatenate([[0], ends[first:last] - begin])]
        yield pa.RecordBatch.from_arrays([docs.slice(first, last - first), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])
        first = last


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row of `docs` (doc_id, text) by the ranks at `path`.

    A null or empty text has an empty array; repeated rows and null ids are encoded like others; other columns don't
    matter; an empty table gives no rows. The runs are kept in bucketed files in the shared folder; the catalog names them only while
    they are written.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # One row of documents and a few of words for each run; a run is in one bucket of the table.
    name, (buckets, word_buckets) = f"bpe_runs_{uuid.uuid4().hex}", widths(docs)
    split_runs(docs, pattern, word_buckets).write.bucketBy(buckets, "run").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    runs = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and the plan above knows their buckets
    ids = replayed(runs.where(F.col("bucket") != DOCUMENTS).repartition("bucket"), path)
    back = ids.select("run", "bucket", "sizes", "data").repartition(buckets, "run").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("bucket", "sizes", "data"))).alias("pieces"))
    whole = runs.where(F.col("bucket") == DOCUMENTS).select("run", "docs", "words", "control", "ranks").hint("merge").join(back, "run", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in ("docs", "words", "control", "ranks", "pieces")}
                pieces = [(p["sizes"], p["data"]) for p in row["pieces"].as_py() or []]
                sizes = row["words"].values.to_numpy()
                n = int(sizes.sum()) + sum((len(p[0]) - 1) // p[0][0] for p in pieces)
                yield from laid_out(row["docs"].values, sizes, unpack_ranks(row["control"].as_py(), row["ranks"].as_py(), n), pieces)

    return whole.select("docs", "words", "control", "ranks", "pieces").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null for null ids. A column named `out` is replaced."""
    rows = rows.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` binary"

    def token_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        lengths = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, lengths = per_process(("bytes", path), token_bytes)
        for batch in batches:
            lists = batch.column(ids)
            got, ends = gathered(flat, starts, lengths, lists.flatten().to_numpy())
            n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            raw = got.tobytes()
            decoded = [raw[a:b] if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_bpe": op6_bpe}
