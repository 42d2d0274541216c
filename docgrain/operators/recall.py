"""Hybrid retrieval in batches: vector, full-text and substring recall, rank fusion, scores, gate, rounds, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as T

from .automaton import finds
from .rows import bounded_batches, dealt, size_checked, spread_join, staged, top

RECALL, SERVED, RRF_K, THRESHOLD, WEIGHT = 50, 8, 60, 0.5, 0.001
MISS = 2147483647


#: Chunks and questions in a block of vectors.
CHUNK_BLOCK, QUESTION_BLOCK = 4096, 256
VECTORS = "principal_id long, ids binary, vectors binary"


def vector_blocks(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """(principal_id, ids, vectors) of rows (principal_id, id, vector): blocks of at most `size` rows of one principal, as bytes."""

    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(key: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(key)))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["principal_id", "ids", "vectors"])

        for batch in batches:
            people, ids = batch.column("principal_id").to_numpy(), batch.column("id").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
            for key in np.unique(people).tolist():
                at = np.flatnonzero(people == key)
                for first in range(0, len(at), size):
                    some = at[first : first + size]
                    held.setdefault(key, []).append((ids[some], vectors[some]))
                    if sum(len(x) for x, _ in held[key]) + size > 2 * size:
                        yield out(key)
        for key in list(held):
            yield out(key)

    return rows.select("principal_id", "id", "vector").mapInArrow(run, VECTORS)


def vector_recall(seen: DataFrame, asked: DataFrame, dim: int, model: str | None = None, n: int = RECALL) -> DataFrame:
    """(query_id, chunk_id, score, rank): the n nearest by cosine (6 digits), then chunk_id.

    `seen`: readable chunks with embedding, embedding_model and principal_id; `asked`: questions with q_embedding. Only
    vectors of one model are compared. Blocks of a principal's chunks and questions meet, each pair of blocks as one product
    of matrices, and only a block's best rows leave it.
    """
    seen = seen.where("embedding IS NOT NULL")
    seen = seen.where(F.col("embedding_model") == model) if model else seen
    seen = seen.where(F.size("embedding") == dim).select(F.col("principal_id").cast("long").alias("principal_id"), F.col("chunk_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = asked.where(F.size("q_embedding") == dim).select(F.col("principal_id").cast("long").alias("principal_id"), F.col("query_id").cast("long").alias("id"), F.col("q_embedding").cast("array<double>").alias("vector"))
    questions = staged(vector_blocks(asked, QUESTION_BLOCK, dim)).toDF("principal_id", "q_ids", "q_vectors")
    pairs = spread_join(vector_blocks(seen, CHUNK_BLOCK, dim), questions, "principal_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                v, q = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), np.frombuffer(row["q_vectors"], "<f8").reshape(-1, dim)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = q @ v.T / np.outer(np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1)))
                score = np.copysign(np.floor(np.abs(cosine) * 1e6 + 0.5) / 1e6, cosine)
                at = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :n]
                found = np.take_along_axis(score, at, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, at.shape[1])), pa.array(ids[at].ravel()), pa.array(found.ravel())], names=["query_id", "chunk_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, chunk_id long, score double").withColumn("score", F.round("score", 6))
    return top(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], n, "rank")


def match_terms(asked: DataFrame, items: Column) -> DataFrame:
    """(query_id, principal_id, grp, item, need, token, groups) of the questions' match items."""
    each = asked.select("query_id", "principal_id", items.alias("items"))
    each = each.withColumn("groups", F.size(F.array_distinct(F.transform("items", lambda x: x["grp"]))))
    each = each.select("query_id", "principal_id", "groups", F.posexplode("items").alias("item", "x"))
    return each.select("query_id", "principal_id", "groups", "item", F.col("x.grp").alias("grp"), F.size("x.tokens").alias("need"), F.explode("x.tokens").alias("token"))


def read_texts(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """The chunks that someone may read, each once and dealt to all cores."""
    return dealt(chunks).join(size_checked(seen.select("chunk_id").distinct(), 200_000), "chunk_id", "left_semi")


def asked_postings(chunks: DataFrame, seen: DataFrame, tokens: Column, terms: DataFrame) -> DataFrame:
    """(principal_id, chunk_id, token) of readable chunks (`seen`), for the tokens that some question asks for.

    A chunk's tokens meet the asked ones right where they are made, and only what is left meets the chunk's readers.
    """
    seen = staged(seen.select("principal_id", "chunk_id"))
    wanted = size_checked(terms.select("token").distinct())
    made = read_texts(chunks, seen).select("chunk_id", F.explode(F.array_distinct(tokens)).alias("token"))
    return made.join(wanted, "token").join(seen, "chunk_id").select("principal_id", "chunk_id", "token")


def text_recall(index: DataFrame, terms: DataFrame, n: int = RECALL) -> DataFrame:
    """(query_id, chunk_id, score, rank): readable chunks that match, by matched items, then chunk_id. `index`: see asked_postings.

    The score stands for a database's text rank, which is not part of the query's definition.
    """
    hits = index.join(size_checked(terms), ["principal_id", "token"]).groupBy("query_id", "chunk_id", "grp", "item", "need", "groups").agg(F.count("*").alias("have")).where("have = need")
    found = hits.groupBy("query_id", "chunk_id", "groups").agg(F.count_distinct("grp").alias("met"), F.count("*").alias("score")).where("met = groups")
    return top(found.select("query_id", "chunk_id", "score"), ["query_id"], [F.desc("score"), F.col("chunk_id")], n, "rank")


#: What may stand between the letters and the digits of a model code.
SEPARATORS = ("", "-", "_", " ")


def spellings(terms: Column) -> Column:
    """(term, form) of each spelling that counts as the term: a model code has one for each separator."""
    code = lambda t: F.rlike(t, F.lit(r"^[a-z]{1,6}-\d{2,6}$"))
    head, tail = (lambda t, i=i: F.split_part(t, F.lit("-"), F.lit(i)) for i in (1, 2))
    forms = lambda t: F.when(code(t), F.array(*(F.concat(head(t), F.lit(s), tail(t)) for s in SEPARATORS))).otherwise(F.array(t))
    return F.flatten(F.transform(terms, lambda t: F.transform(forms(t), lambda f: F.struct(t.alias("term"), f.alias("form")))))


def substring_recall(chunks: DataFrame, seen: DataFrame, asked: DataFrame, terms: Column, n: int = RECALL) -> DataFrame:
    """(query_id, chunk_id, place, rank): readable chunks (`seen`) whose content or heading has a term, by the place of the longest.

    One automaton of all asked terms passes each readable text once; a chunk's finds then meet its readers' questions.
    """
    asked = asked.select("query_id", "principal_id", terms.alias("terms")).where(F.size("terms") > 0)
    asked = asked.select("query_id", "principal_id", F.get("terms", F.lit(0)).alias("longest"), F.explode(spellings(F.col("terms"))).alias("x"))
    asked = staged(asked.select("query_id", "principal_id", F.col("x.form").alias("term"), (F.col("x.form") == F.col("longest")).alias("leads")))
    rows = staged(seen.select("principal_id", "chunk_id"))
    texts = read_texts(chunks, rows).select("chunk_id", F.explode(F.array("content", "heading_path")).alias("text"))
    held = finds(texts.select("chunk_id", F.lower("text").alias("text")), "text", asked.select("term"))
    held = held.groupBy("chunk_id", "term").agg(F.min("place").alias("place"))
    met = held.join(rows, "chunk_id").join(size_checked(asked), ["principal_id", "term"])
    found = met.groupBy("query_id", "chunk_id").agg(F.coalesce(F.min(F.when(F.col("leads"), F.col("place"))), F.lit(MISS)).alias("place"))
    return top(found, ["query_id"], ["place", "chunk_id"], n, "rank")


def fused(paths: dict[str, DataFrame]) -> DataFrame:
    """(query_id, chunk_id, rrf, path flags): reciprocal rank fusion of ranked lists, in the paths' order."""
    rows = None
    for i, (name, df) in enumerate(paths.items()):
        one = df.select("query_id", "chunk_id", "rank", F.lit(i).alias("path"))
        rows = one if rows is None else rows.unionByName(one)
    flags = [F.bool_or(F.col("path") == i).alias(name) for i, name in enumerate(paths)]
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.min("path").alias("first_path"), *flags)


def candidates(fused_rows: DataFrame, n: int = RECALL) -> DataFrame:
    return top(fused_rows, ["query_id"], [F.desc("rrf"), F.col("first_path"), F.col("chunk_id")], n)


def reranked(scores: DataFrame, fallback: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the reranker's scores; for a query of which it left one out, all of the fallback's."""
    failed = scores.where("score IS NULL").select("query_id").distinct()
    return scores.join(failed, "query_id", "left_anti").unionByName(fallback.select("query_id", "chunk_id", "score").join(failed, "query_id", "left_semi"))


def served(cands: DataFrame, scores: DataFrame, weights: DataFrame, n: int = SERVED) -> DataFrame:
    """The n best by base score (cosine, 0 without) plus governance weight; rank from 1."""
    rows = cands.join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left").join(weights.select("chunk_id", "governance_weight"), "chunk_id", "left")
    final = F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("governance_weight", F.lit(0)) * WEIGHT, 6)
    return top(rows.withColumn("final_score", final).drop("governance_weight"), ["query_id"], [F.desc("final_score"), F.desc("rrf"), F.col("chunk_id")], n, "rank")


def gate(asked: DataFrame, rows: DataFrame, people: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, top1, status): refused without knowledge bases, and under the threshold."""
    best = rows.groupBy("query_id").agg(F.max("final_score").alias("top1"))
    scope = people.select("principal_id", (F.size("kbs") == 0).alias("empty"))
    out = asked.select("query_id", "principal_id").join(size_checked(scope), "principal_id", "left").join(best, "query_id", "left")
    status = F.when(F.coalesce("empty", F.lit(True)), "NO_AUTHORIZED_KB").when(F.coalesce("top1", F.lit(-1.0)) < threshold, "NO_RELEVANT_CONTENT").otherwise("OK")
    return out.select("query_id", F.when(F.col("empty"), None).otherwise(F.col("top1")).alias("top1"), status.alias("status"))


def path_stats(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Per query and path: served rows that the path found, and those that only it found."""
    others = {p: F.lit(False) for p in paths}
    for p in paths:
        for q in paths:
            others[p] = others[p] | F.col(q) if q != p else others[p]
    each = [f for p in paths for f in (F.count_if(F.col(p)).alias(f"{p}_covered"), F.count_if(F.col(p) & ~others[p]).alias(f"{p}_unique"))]
    return rows.groupBy("query_id").agg(*each)


def merged_rounds(rounds: DataFrame, n: int = SERVED, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (query_id, round, rank, chunk_id, final_score) of several rounds: each chunk once with its best score, ordered
    by fusion of the round orders; nothing for a query whose best score is under the threshold."""
    one = rounds.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.max("final_score").alias("final_score"), F.min(F.struct("round", "rank")).alias("first"))
    good = one.groupBy("query_id").agg(F.max("final_score").alias("m")).where(F.col("m") >= threshold).select("query_id")
    return top(one.join(good, "query_id", "left_semi"), ["query_id"], [F.desc("rrf"), F.col("first"), F.col("chunk_id")], n, "rank").drop("first")


def exclusive(rows: DataFrame) -> DataFrame:
    """Rows (query_id, class, pos, chunk_id) where each chunk stays in its first class."""
    return top(rows, ["query_id", "chunk_id"], ["class", "pos"], 1)


def numbered_context(rows: DataFrame) -> DataFrame:
    """Citation numbers n: by class, then place."""
    from pyspark.sql import Window

    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("class", "pos", "chunk_id")))


def clean_subquestions(parts: Column, original: Column, n: int = 3, most: int = 120) -> Column:
    """The original first, then new ones that aren't empty, too long or repeated; white space collapsed."""
    squeezed = F.transform(F.array_insert(parts, 1, original), lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))
    kept = F.filter(squeezed, lambda q, i: (i == 0) | ((q != "") & (F.length(q) <= most)))
    return F.slice(F.array_distinct(kept), 1, n)


def route(score: Column, rewritten: Column, has_history: Column) -> Column:
    """Clarify, chain or direct: by the rewrite score."""
    clarify = score.isNotNull() & (score < 70) & ~rewritten & ~has_history
    return F.when(clarify, "clarify").when(score.isNotNull() & (score < 90), "chain").otherwise("direct")
