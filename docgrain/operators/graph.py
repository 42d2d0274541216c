"""Property graph as three tables: upserts, bounded expansion, seed linking, budgets, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import hub_join, is_small, size_checked, staged, top, within_budget

MAX_HOPS, TOP, SEEDS = 2, 10, 8
#: Mentions that one task counts when documents are deleted.
TASK_ROWS = 500_000


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` with the rows of `new`: of one key the new row wins, of several the last by `order`. Same columns but `order`."""
    last = top(new, keys, [F.desc(order)], 1).drop(order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks, each once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def relation_support(raw: DataFrame) -> DataFrame:
    """(src, dst, relation, support) of a document set's triples, self-loops and empty relations dropped."""
    return raw.where("src <> dst AND relation <> ''").groupBy("src", "dst", "relation").agg(F.count("*").alias("support"))


def without_documents(entities: DataFrame, mentions: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph after documents are deleted: their mentions and relations, then entities nobody mentions; frequencies anew.

    Mentions are dealt by document to as many tasks as their counted rows need: there they meet the deleted documents and become
    distinct, so only an entity's counts go on.
    """
    parts = -(-mentions.count() // TASK_ROWS) or 1
    dealt = lambda df: df.repartition(parts, "document_id")
    small = size_checked(gone.select("document_id"))
    relations = relations.join(small, "document_id", "left_anti")
    mentions = dealt(mentions).join(small if is_small(gone) else dealt(gone.select("document_id")), "document_id", "left_anti")
    freq = mentions.select("entity_id", "document_id").distinct().groupBy("entity_id").agg(F.count("document_id").alias("doc_freq"))
    return entities.drop("doc_freq").join(freq, "entity_id"), mentions, relations


def expand(seeds: DataFrame, relations: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(query_id, entity_id, hop, weight) reached from seeds (query_id, entity_id) along directed relations (src, dst,
    support). Seeds have hop 1 and no weight; a path never meets an entity twice; hops are smallest, weights add up. A
    repeated seed or relation makes paths of its own.

    No path is held: a frontier has, for each query, seed and entity, how many paths lead there and their summed weights, so its
    size doesn't grow with their number. Walks that come back are kept out: to the seed by a condition, as each frontier knows
    its seed, and in the fourth hop to the entity two steps before by subtracting the walks that go there and back. So
    `max_hops` is at most 4.
    """
    if not 1 <= max_hops <= 4:
        raise ValueError("paths of more than four hops need their entities held")
    edges = staged(relations.where("src <> dst").select(F.col("src").alias("entity_id"), "dst", F.col("support").cast("long").alias("support")))
    first = seeds.groupBy("query_id", "entity_id").agg(F.count("*").alias("paths"))
    frontiers = [staged(first.select("query_id", F.col("entity_id").alias("seed"), "entity_id", "paths", F.lit(0).cast("long").alias("weight")))]
    for hop in range(2, max_hops + 1):
        steps = hub_join(frontiers[-1], edges, "entity_id", "dst").where("dst <> seed")
        steps = steps.select("query_id", "seed", F.col("dst").alias("entity_id"), "paths", (F.col("weight") + F.col("paths") * F.col("support")).alias("weight"))
        if hop == 4:
            steps = steps.unionByName(returning(frontiers[1], edges))
        sums = steps.groupBy("query_id", "seed", "entity_id").agg(F.sum("paths").alias("paths"), F.sum("weight").alias("weight"))
        frontiers.append(staged(sums.where("paths > 0")))
    out = frontiers[0].withColumn("hop", F.lit(1))
    for hop, frontier in enumerate(frontiers[1:], 2):
        out = out.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return out.groupBy("query_id", "entity_id").agg(F.min("hop").alias("hop"), F.sum("weight").alias("weight"))


def returning(second: DataFrame, edges: DataFrame) -> DataFrame:
    """Minus the walks seed, entity, other, entity of the second frontier: there and back between the entity and any other but the seed."""
    back = edges.select(F.col("dst").alias("entity_id"), F.col("entity_id").alias("dst"), F.col("support").alias("home"))
    both = staged(edges.join(back, ["entity_id", "dst"]).groupBy("entity_id", "dst").agg(F.count("*").alias("n"), F.sum(F.col("support") + F.col("home")).alias("total")))
    all_of = both.groupBy("entity_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    own = both.select("entity_id", F.col("dst").alias("seed"), F.col("n").alias("own_n"), F.col("total").alias("own_total"))
    walks = second.join(all_of, "entity_id").join(own, ["entity_id", "seed"], "left")
    n, total = (F.col(c) - F.coalesce(f"own_{c}", F.lit(0)) for c in ("n", "total"))
    return walks.select("query_id", "seed", "entity_id", (-F.col("paths") * n).alias("paths"), (-(F.col("weight") * n + F.col("paths") * total)).alias("weight"))


def neighbours(reached: DataFrame, mentions: DataFrame, seen: DataFrame, n: int = TOP) -> DataFrame:
    """(query_id, chunk_id, hop, weight, rank): readable chunks that mention reached entities, nearest first.

    `reached` has a principal_id; `seen` is (principal_id, chunk_id).
    """
    hits = hub_join(reached, mentions.select("entity_id", "chunk_id"), "entity_id", "chunk_id").join(seen.select("principal_id", "chunk_id"), ["principal_id", "chunk_id"], "left_semi")
    found = hits.groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"), F.sum("weight").alias("weight"))
    return top(found, ["query_id"], [F.col("hop"), F.desc("weight"), F.col("chunk_id")], n, "rank")


def graph_chunks(found: DataFrame, hits: DataFrame, costs: DataFrame, rows: int = 3, budget: int = 1200) -> DataFrame:
    """The neighbours that join the context: without the hits, then the leading ones within the token budget."""
    new = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(costs.select("chunk_id", "token_count"), "chunk_id")
    return within_budget(new, ["query_id"], ["rank"], "token_count", rows, budget)


def link_score(name: Column, key: Column, layer: Column) -> Column:
    by_form = F.when(name == key, 1.0).when(F.startswith(name, key), 0.6).when(F.contains(name, key), 0.3).otherwise(0.0)
    return F.greatest(by_form, layer)


def linked(layers: DataFrame, n: int = SEEDS) -> DataFrame:
    """Seeds of each query from layered hits (query_id, entity_id, name_key, key, layer): best score, then name."""
    best = layers.groupBy("query_id", "entity_id", "name_key").agg(F.max(link_score(F.col("name_key"), F.col("key"), F.col("layer"))).alias("score"))
    return top(best, ["query_id"], [F.desc("score"), F.col("name_key"), F.col("entity_id")], n)


def tree(nodes: DataFrame, key: str, parent: str, name: str | None = None) -> DataFrame:
    """Nodes with depth and root; a node whose parent isn't there is a root, and one on or below a circle has no row. With
    `name`, also path: the names from the root down, in slashes.

    Pointers double: a node that points some levels up takes over where that node points, until it points at a root. So a
    tree of n levels takes log n rounds, each staged; a round that finishes no node leaves circles only. `key` is unique.
    """
    own = F.concat(F.lit("/"), F.col(name)) if name else F.lit("")
    nodes = staged(nodes.select(F.col(key).alias("node"), F.col(parent).alias("parent"), own.alias("tail")))
    there = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("below"))
    state = nodes.join(there, "parent", "left")
    state = staged(state.select("node", F.when(F.col("below"), F.col("parent")).otherwise(F.col("node")).alias("up"), F.when(F.col("below"), 1).otherwise(0).alias("steps"), F.col("below").isNull().alias("done"), "tail"))
    done = [state.where("done")]
    pending = state.where("NOT done")
    while not pending.isEmpty():
        above = done[0]
        for d in done[1:]:
            above = above.unionByName(d)
        above = above.unionByName(pending).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"), F.col("tail").alias("head"))
        moved = hub_join(above, pending.drop("done"), "up", "node")
        moved = staged(moved.select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"), F.concat("head", "tail").alias("tail")))
        pending = moved.where("NOT done")
        if moved.where("done").isEmpty():
            break
        done.append(moved.where("done"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    path = [F.concat("tail", F.lit("/")).alias("path")] if name else []
    return out.select(F.col("node").alias(key), F.col("steps").cast("int").alias("depth"), F.col("up").alias("root"), *path)
