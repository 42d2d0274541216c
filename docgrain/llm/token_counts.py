"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut where no token can cross (see `_pieces.words`), and what stays long is cut further where a match of the
pattern ends (`_pieces.safe_parts`: before white space of any kind, or before marks, Chinese ones too). Only a single run of
letters, which is one match, stays whole. Each distinct part is encoded once in a worker, in batches of about equal
bytes, and only its count is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import safe_parts, tokenizer, words
from ._shared import BATCH_BYTES, bounded_batches, by_bytes, per_process, table, text_runs

#: Bytes that one call of the library encodes.
CALL_BYTES = 64 << 10
#: Characters beyond which a part is cut further, so that none is more than a call.
PART = 16 << 10
#: Counts kept in a worker; beyond, parts are counted again, which changes no result.
KEPT = 500_000


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class Counter:
    """Counts of texts by a tokenizers file; special strings in a text count as the library's default has them."""

    def __init__(self, path: str):
        self.encoder, self.kept = tokenizer(path), {}
        self.special = tuple(t.content for t in self.encoder.get_added_tokens_decoder().values())

    def encoded(self, parts: list[str]) -> list[int]:
        """Counts of each part, in calls of about CALL_BYTES."""
        runs = by_bytes(map(utf8_length, parts), CALL_BYTES)
        return list(chain.from_iterable((len(e) for e in self.encoder.encode_batch_fast(parts[a:b], add_special_tokens=False)) for a, b in runs))

    def lengths(self, parts: list[str]) -> list[int]:
        if max(map(len, parts), default=0) <= PART:
            return self.encoded(parts)
        cut = [safe_parts(p, PART, self.special) for p in parts]
        found = iter(self.encoded(list(chain.from_iterable(cut))))
        return [sum(islice(found, len(c))) for c in cut]

    def counts(self, texts: list[str]) -> list[int]:
        split = [words(t) for t in texts]
        heads = self.lengths([p[0] for p in split])
        new = list(set(chain.from_iterable(p[1:] for p in split)).difference(self.kept))
        full = len(self.kept) >= KEPT
        self.kept.update(zip(new, self.lengths([f" {w}" for w in new])))
        found = [h + sum(map(self.kept.__getitem__, p[1:])) for h, p in zip(heads, split)]
        for w in new:
            if full or len(w) > 64:
                del self.kept[w]
        return found


class PieceCounter:
    """Counts of texts by a sentencepiece model, which sees whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of `docs` (doc_id, text).

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids are counted like others; other columns
    don't matter; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    make = PieceCounter if path.endswith(".model") else Counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("counter", path), lambda: make(path))
        for batch, texts in text_runs(batches, limit=BATCH_BYTES // 2):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_token_counts": op7_token_counts}
