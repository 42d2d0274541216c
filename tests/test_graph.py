"""Expansion by frontiers against paths; trees against levels."""

import random
from collections import defaultdict

import pytest

from docgrain.operators import graph, rows


def by_paths(seeds, edges, hops):
    out = defaultdict(lambda: [99, 0])
    walk = [(q, e, 0, (e,)) for q, e in seeds]
    for hop in range(1, hops + 1):
        for q, e, w, _ in walk:
            at = out[q, e]
            at[0], at[1] = min(at[0], hop), at[1] + w
        walk = [(q, d, w + s, (*path, d)) for q, e, w, path in walk for a, d, s in edges if a == e and d not in path]
    return {(q, e, *v) for (q, e), v in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_frontiers_give_what_paths_give(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(rows, "HUB_ROWS", 3 if seed % 2 else 100_000)
    n = r.randrange(4, 9)
    edges = [(r.randrange(n), r.randrange(n), r.randrange(1, 5)) for _ in range(r.randrange(8, 40))]
    edges += edges[:2]
    seeds = [(r.randrange(3), r.randrange(n)) for _ in range(5)]
    seeds += seeds[:1]
    s = spark.createDataFrame(seeds, "query_id long, entity_id long")
    e = spark.createDataFrame(edges, "src long, dst long, support long")
    for hops in (1, 2, 3, 4):
        got = graph.expand(s, e, hops).select("query_id", "entity_id", "hop", "weight")
        assert {tuple(x) for x in got.collect()} == by_paths(seeds, edges, hops)


def test_a_frontier_does_not_grow_with_paths(spark):
    """Forty entities, each linked with each: 54,834 paths of four hops from a seed, and forty rows."""
    edges = [(a, b, 1) for a in range(40) for b in range(40) if a != b]
    got = graph.expand(spark.createDataFrame([(0, 0)], "query_id long, entity_id long"), spark.createDataFrame(edges, "src long, dst long, support long"), 4)
    found = {r["entity_id"]: r["weight"] for r in got.collect()}
    # To each other entity: one path of one edge, 38 of two, 38 * 37 of three.
    assert len(found) == 40 and found[0] == 0 and found[7] == 1 + 38 * 2 + 38 * 37 * 3


def test_five_hops_are_refused(spark):
    with pytest.raises(ValueError):
        graph.expand(spark.createDataFrame([(0, 0)], "query_id long, entity_id long"), spark.createDataFrame([(0, 1, 1)], "src long, dst long, support long"), 5)


def test_a_chain_takes_log_rounds(spark, monkeypatch):
    """Ten thousand levels, branches, and circles with what hangs on them."""
    n, staged = 10_000, []
    monkeypatch.setattr(graph, "staged", lambda df: staged.append(1) or rows.staged(df))
    links = [(i, i - 1) for i in range(n)] + [(n + i, 17 * i) for i in range(50)] + [(20_000, 20_001), (20_001, 20_000), (20_002, 20_001), (20_003, 20_003), (30_000, None)]
    df = spark.createDataFrame(links, "k long, p long")
    got = {r["k"]: (r["depth"], r["root"]) for r in graph.tree(df, "k", "p").collect()}
    want = {i: (i, 0) for i in range(n)} | {n + i: (17 * i + 1, 0) for i in range(50)} | {30_000: (0, 30_000)}
    assert got == want and len(staged) <= 2 + 15


def test_paths_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(rows, "HUB_ROWS", 4)
    links = [("r", None, "root")] + [(f"c{i}", "r", f"n{i}") for i in range(30)] + [("d", "c3", "deep")]
    got = {r["k"]: (r["depth"], r["path"]) for r in graph.tree(spark.createDataFrame(links, "k string, p string, name string"), "k", "p", "name").collect()}
    assert got == {"r": (0, "/root/"), "d": (2, "/root/n3/deep/")} | {f"c{i}": (1, f"/root/n{i}/") for i in range(30)}
    assert graph.tree(spark.createDataFrame([], "k string, p string"), "k", "p").collect() == []


def test_pages(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(rows, "RUN_ROWS", 7)
    r = random.Random(6)
    values = [(i, r.randrange(9) if i % 5 else None) for i in range(60)]
    order = sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    index = rows.PageIndex(spark.createDataFrame(values, "i long, v long").repartition(3), [F.desc_nulls_last("v"), F.col("i")])
    assert index.total == 60 and len(index.counts) > 4
    for number, size in ((1, 8), (3, 8), (8, 8), (9, 8), (1, 100), (2, 25), (60, 1)):
        assert [tuple(x) for x in index.page(number, size).collect()] == order[(number - 1) * size : number * size]
    assert len(index.page(2, 5).inputFiles()) < len(index._rows(index.schema).inputFiles())
    assert rows.PageIndex(spark.createDataFrame([], "i long"), [F.col("i")]).page(1, 5).collect() == []
