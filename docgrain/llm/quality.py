"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from its n-grams: hashed byte 4-grams, words and word pairs. For each bucket the log odds
of occurring in good and bad documents are counted over the labelled rows, in two folds; a document is scored by the counts
of the other fold, so it never speaks for itself. The means of its buckets' log odds, with how many words echo the one
before and how many differ, are weighed by a logistic regression on the labelled rows, which gives a log likelihood ratio.

Sites are hosts and, below them, paths. The sum of the other documents' probabilities on a host shrinks toward the
global prior, that on a path toward its host, each with a strength estimated from the spread between sites (moments of a beta
distribution), so sparse sites stay near what stands above them. The path's posterior is the prior of the document's
evidence; the document itself is left out of both sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, broadcast_checked, salted_join, staged, table, text_digest, text_runs, without

#: Buckets of each kind of n-gram.
BUCKET_BITS = 15
KINDS = ("bytes", "words", "pairs")
FEATURES = (*KINDS, "echo", "variety")
#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their id; statistics of sites cover all rows.
TRAIN_ROWS = 150_000
#: What every count of documents starts with.
SMALL = 0.5
#: Bounds of the estimated prior strengths, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Probabilities are summed as whole numbers, so that their order doesn't matter.
SCALE = 1_000_000_000
#: Rows of one path beyond which a join deals them to several tasks.
HOT_ROWS = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Weights of the bytes of a word by their place.
PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each word (bytes between ASCII blanks)."""
    at = np.flatnonzero(~BLANK[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    place = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
    return mixed(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * PLACES[place & 63], first))


def buckets(text: str) -> tuple[list[np.ndarray], float, float]:
    """The buckets of a text's n-grams by kind, in order; the share of words that echo the one before, and of different ones."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    wide = raw.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24) if len(raw) > 3 else wide[:0]
    words = word_hashes(raw)
    pairs = mixed(words[:-1] * MULTIPLIER + words[1:])
    high = np.uint64(64 - BUCKET_BITS)
    found = [(grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), words >> high, pairs >> high]
    n = max(len(words), 1)
    return [x.astype(np.int64) for x in found], float(np.count_nonzero(words[1:] == words[:-1])) / n, len(np.unique(words)) / n


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(2)), F.lit(0)).cast("int")


def sited(docs: DataFrame) -> DataFrame:
    """(doc_id, own, host, path, fold, text): host is the source, a path the source's part in one language."""
    host = F.coalesce("source", F.lit(""))
    return docs.select("doc_id", text_digest(docs["text"]).alias("own"), host.alias("host"), F.concat_ws("/", host, F.coalesce("lang", F.lit(""))).alias("path"), fold_of(F.col("doc_id")).alias("fold"), "text")


@dataclass
class Model:
    """Log odds of buckets by the fold to score, then kind; the regression's weights and shift; the global log odds."""

    tables: np.ndarray
    weights: np.ndarray
    shift: float
    odds: float

    def features(self, text: str, fold: int) -> list[float]:
        found, echo, variety = buckets(text)
        return [float(t[b].mean()) if len(b) else 0.0 for t, b in zip(self.tables[fold], found)] + [echo, variety]

    def evidence(self, text: str, fold: int) -> float:
        """Log likelihood ratio of a text; 0 for one without words."""
        if not text.strip("\t\n\x0b\x0c\r "):
            return 0.0
        return float(np.dot(self.weights, self.features(text, fold))) + self.shift


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of at most TRAIN_ROWS or so labelled documents; contradicting labels count as good."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    marked = staged(marked)
    n = marked.count()
    if n > TRAIN_ROWS:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < F.lit(int(TRAIN_ROWS / n * (1 << 30))))
    return marked


def count_buckets(known: DataFrame) -> np.ndarray:
    """Documents (a row each of y, fold, text) that hold each bucket: by label, fold, kind, bucket."""
    width = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 2, len(KINDS), width), np.int64)
        for batch, texts in text_runs(batches):
            for y, fold, text in zip(batch.column("y").to_pylist(), batch.column("fold").to_pylist(), texts):
                for kind, b in enumerate(buckets(text)[0]):
                    held[y, fold, kind] += np.bincount(b, minlength=width) > 0
        flat = held.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    counts = np.zeros(4 * len(KINDS) * width, np.int64)  # the driver gets one row for each bucket at most
    found = known.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(2, 2, len(KINDS), width)


def log_odds(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Of each bucket, for a document of each fold, by the other fold's counts; `documents` by label and fold."""
    rate = np.log((counts + SMALL) / (documents[:, :, None, None] + 2 * SMALL))
    return (rate[1] - rate[0])[::-1]


def regression(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and shift of a logistic regression, lightly bound, by Newton's steps on standardised columns."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    bound = np.array([*[1.0] * x.shape[1], 1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(bound), z.T @ (y - p) - bound * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / deviation, float(w[-1] - (w[:-1] / deviation) @ mean)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows; one without evidence where a label or all labels are missing."""
    width = 1 << BUCKET_BITS
    known = sited(docs).select("doc_id", "own", "fold", "text").join(broadcast_checked(training_rows(labels)), "doc_id").select("doc_id", "own", "y", "fold", "text")
    counted = {(r["y"], r["fold"]): r["n"] for r in known.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    documents = np.array([[counted.get((y, f), 0) for f in (0, 1)] for y in (0, 1)])
    bad, good = documents.sum(1)
    odds = math.log((good + 1) / (bad + 1))
    blank = Model(np.zeros((2, len(KINDS), width)), np.zeros(len(FEATURES)), 0.0, odds)
    if not bad or not good:
        return blank
    model = Model(log_odds(count_buckets(known.select("y", "fold", "text")), documents), blank.weights, 0.0, odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            rows = [model.features(t, f) for t, f in zip(texts, batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "own", "y", "x"])

    rows = known.select("doc_id", "own", "y", "fold", "text").mapInArrow(run, "doc_id long, own string, y int, x array<double>")
    found = rows.orderBy("doc_id", "own").toArrow()  # TRAIN_ROWS short rows or so, in one order
    x, y = np.array(found.column("x").to_pylist()), found.column("y").to_numpy().astype(float)
    weights, shift = regression(x, y)
    return Model(model.tables, weights, shift - odds, odds)


def evidence_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, own, host, path, evidence, p) of each row: p (in parts of SCALE) with the global prior."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches):
            found = np.array([model.evidence(t, f) for t, f in zip(texts, batch.column("fold").to_pylist())])
            p = np.rint(SCALE / (1 + np.exp(-np.clip(found + model.odds, -500, 500)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "own", "host", "path")), pa.array(found), pa.array(p)], names=["doc_id", "own", "host", "path", "evidence", "p"])

    return sited(docs).mapInArrow(run, "doc_id long, own string, host string, path string, evidence double, p long")


def strength(sites: DataFrame) -> float:
    """Documents that a site's prior is worth: from the spread of site means (`good`, `n`) round `mean` beyond what their sizes explain."""
    p, n = F.col("good") / F.col("n"), F.col("n").cast("double")
    within = F.col("mean") * (1 - F.col("mean"))
    r = sites.where("n >= 2").agg(F.sum(n * (p - F.col("mean")) ** 2 - within).alias("excess"), F.sum(n).alias("n"), F.count("*").alias("sites"), F.sum(n * n).alias("sq"), F.avg(within).alias("within")).first()
    if not r["sites"] or r["sites"] < 2:
        return STRONGEST
    between = r["excess"] / max(r["n"] - r["sq"] / r["n"], 1e-9)
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, r["within"] / between - 1))


def site_sums(scored: DataFrame, prior: float) -> tuple[DataFrame, float, float]:
    """(path, good, n, host_good, host_n) of all paths, from sums over all documents, and the strengths of hosts' and paths' priors."""
    paths = staged(scored.groupBy("host", "path").agg((F.sum("p") / SCALE).alias("good"), F.count("*").alias("n")))
    hosts = staged(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")))
    a = strength(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n"), F.lit(prior).alias("mean")))
    sites = staged(salted_join(paths, hosts, "host", "path", HOT_ROWS))
    b = strength(sites.select("good", "n", ((F.col("host_good") + a * prior) / (F.col("host_n") + a)).alias("mean")))
    return sites.drop("host"), a, b


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source): doc_id, host, path, evidence, host_posterior, path_posterior,
    p_quality, kept.

    Trained on `labels` (doc_id, quality): every labelled row counts, up to TRAIN_ROWS. A null text counts as empty and has no
    evidence; a null source or language is a site of its own; a row with a null id is classified but trains nothing;
    repeated rows are classified alike. Without labels of both kinds there is no evidence; without any every document has
    the prior one half and stays. Other columns don't matter; an empty table gives no rows.
    """
    return decided(docs, labels, threshold).drop("own")


def decided(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    model = fit(docs, labels)
    prior = 1 / (1 + math.exp(-model.odds))
    scored = staged(evidence_rows(docs, model))
    sites, a, b = site_sums(scored, prior)
    own = F.col("p") / SCALE
    # The document itself is left out of its host's and its path's sums.
    host = ((F.col("host_good") - own + a * prior) / (F.col("host_n") - 1 + a)).alias("host_posterior")
    path = ((F.col("good") - own + b * F.col("host_posterior")) / (F.col("n") - 1 + b)).alias("path_posterior")
    out = salted_join(scored, sites, "path", "own", HOT_ROWS).select("doc_id", "own", "host", "path", "evidence", "good", "n", "p", host)
    out = out.select("doc_id", "own", "host", "path", "evidence", "host_posterior", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), path)).alias("path_posterior"))
    p = (1 / (1 + F.exp(-(F.col("evidence") + F.ln(F.col("path_posterior") / (1 - F.col("path_posterior"))))))).alias("p_quality")
    return out.select("*", p).withColumn("kept", F.col("p_quality") >= threshold - 1e-9)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that the classifier keeps; a row is told by its id and its text."""
    return without(docs, decided(docs, labels, threshold).where(~F.col("kept")).select("doc_id", F.col("own").alias("digest")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shown = [F.round(c, 6).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "p_quality")]
    return found.select("doc_id", "host", "path", *shown, "kept")


QUERIES = {"op10_quality": op10_quality}
