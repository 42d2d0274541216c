"""Walks over many levels, office files with odd parts, and answers that fall back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrain.engine import Engine
from docgrain.functions import text as T
from docgrain.operators import acl, graph, images, lexicon, recall
from docgrain.plans import _made, registry
from docgrain.sources import office, web
from docgrain.sources import substrate as S


def test_reach_goes_over_all_levels(spark):
    edges = [(i, i + 1) for i in range(45)] + [(i, i // 2) for i in range(45)] + [(100, 101), (44, 44)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["depth"] for r in web.reachable(frame, spark.createDataFrame([(9,), (9,)], "node long")).collect()}
    want, level, depth = {9: 0}, {9}, 0
    while level:
        depth += 1
        level = {b for a, b in edges if a in level} - set(want)
        want |= dict.fromkeys(level, depth)
    assert got == want and max(want.values()) > 30
    few = {r["node"]: r["depth"] for r in web.reachable(frame, spark.createDataFrame([(9,)], "node long"), cap=4).collect()}
    assert few == {9: 0, 4: 1, 10: 1, 2: 2}
    assert web.reachable(frame.limit(0), spark.createDataFrame([(1,)], "node long")).count() == 1


def test_tree_of_many_levels_and_a_circle(spark):
    rows = [(i, i - 1 if i else None) for i in range(26)] + [(100, 101), (101, 100), (50, 77)]
    got = {r["k"]: (r["depth"], r["root"]) for r in graph.tree(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert got == {**{i: (i, 0) for i in range(26)}, 50: (0, 50)}


def test_office_files():
    for parse in (office.docx_blocks, office.xlsx_blocks, office.pptx_blocks):
        assert parse(b"") == [] and parse(None) == []
        with pytest.raises(ValueError):
            parse(b"no zip")
    docx = office.docx_blocks(_made.docx_of("S", "body & more".replace("&", "&amp;"), "L", "a", "b"))
    assert docx[1] == ("body & more", "S", False, False) and docx[-1][0] == "k\tk\tv\na\tb\tx\na\ty\tL"
    assert office.place("AB12") == (11, 27)
    assert [b[1] for b in office.xlsx_blocks(_made.xlsx_of("a", "b", "7", "L", "S", "x"))] == ["first", "second"]
    assert office.pptx_blocks(_made.pptx_of("T", "x", "a", "b"))[-1] == ("k\tv\na\tb", "第2页", True, False)


def test_reranker_that_leaves_out_a_row(spark):
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (2, 1, 0.25)], "query_id long, chunk_id long, score double")
    vector = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.8), (2, 1, 0.7)], "query_id long, chunk_id long, score double")
    assert sorted(tuple(r) for r in recall.reranked(scores, vector).collect()) == [(1, 1, 0.9), (1, 3, 0.8), (2, 1, 0.25)]


def test_documents_are_visible_by_all_their_chunks(spark):
    chunks = spark.createDataFrame([(1, 10, ["public"], [], True), (1, 20, ["g"], [], True), (2, 10, ["public"], ["u"], True), (3, 30, ["g"], None, True), (3, 10, ["x"], [], False), (4, 10, [], [], True)], "document_id long, level_rank int, acl_tags array<string>, deny_subjects array<string>, is_latest boolean")
    people = spark.createDataFrame([(1, 20, ["public", "u"]), (2, 30, ["public", "g"]), (3, 40, ["nobody"])], "principal_id int, clearance int, subjects array<string>")
    got = {(r["principal_id"], r["document_id"]) for r in acl.fully_visible_documents(chunks, people).collect()}
    assert got == {(2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4)}


def test_rebuilt_lexicon(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "kb_id string, term string")
    new = spark.createDataFrame([("a", "z"), ("a", "z"), ("c", "w")], "kb_id string, term string")
    assert sorted(tuple(r) for r in lexicon.rebuilt(old, new, spark.createDataFrame([("a",)], "kb_id string")).collect()) == [("a", "z"), ("b", "y")]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("#### 核心业务1. 语言 2. 图像", "#### 核心业务\n1. 语言\n2. 图像"),
        ("## 标题 正文开始", "## 标题\n\n正文开始"),
        ("## one two three", "## one two\n\nthree"),
        ("a\n\n\n\nb ", "a\n\nb"),
        ("1. x\n\n2. y\n\nend", "1. x\n2. y\n\nend"),
        ("intro 1. x", "intro\n1. x"),
        ("plain text stays", "plain text stays"),
        ("", ""),
    ],
)
def test_line_breaks(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.line_breaks(F.col("t"))).first()[0] == want


def test_image_measures_pixel_by_pixel():
    rng = np.random.default_rng(1)
    level = np.where(rng.random((23, 31)) < 0.12, 20, rng.integers(190, 256, (23, 31))).astype(np.uint8)
    level[5:13, 4:12] = 90
    got = images.measures(level)
    at = lambda y, x: int(level[min(max(y, 0), 22), min(max(x, 0), 30)])
    spots = [(y, x) for y in range(23) for x in range(31)]
    near = lambda y, x, r: [at(y + j, x + i) for j in range(-r, r + 1) for i in range(-r, r + 1)]
    noise = sum(at(*s) < 100 and sum(v < 100 for v in near(*s, 1)) <= 1 for s in spots) / len(spots)
    stain = sum(all(v < 128 for v in near(*s, 2)) for s in spots) / len(spots)
    assert np.allclose(got[1:3], (noise, stain)) and noise > 0 and stain == 16 / len(spots)
    flat = sorted(level.ravel().tolist())
    assert got[7] == next(v for v in range(256) if sum(x <= v for x in flat) >= 0.8 * len(flat))
    assert images.measures(np.array([[[200, 10, 20], [10, 200, 20]]], np.uint8))[6] == 0.5


def test_measured_images(spark):
    rows = [(1, 600, 600, bytes([255]) * 360_000), (2, 2, 2, bytes([10, 10, 10, 10])), (3, 2, 2, b"x"), (4, None, None, None), (5, 600, 600, bytes([212]) * 360_000)]
    got = images.measured(spark.createDataFrame(rows, "id int, width int, height int, pixels binary"))
    got = {r["id"]: r for r in got.select("*", images.quality_verdict(F.lit(True), F.lit(0.0)).alias("verdict"), images.watermarked().alias("marked")).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 5)] == ["pass", "reject_to_manual", "enhance"] and got[3]["dark_ratio"] is None and got[4]["bg_level"] is None
    assert not got[5]["marked"]


def test_engine_serves_what_the_plan_serves(spark, sf):
    asked = S.with_query_vectors(S.questions(spark, sf), spark, sf)
    chunks, engine = S.chunks(spark, sf, True), Engine(spark)
    shown = ["query_id", "chunk_id", "final_score", "rank"]
    got = sorted(map(tuple, engine.search(chunks, S.principals(spark), asked, S.DIM).select(shown).collect()))
    want = sorted(map(tuple, registry.queries()["rt8_top_served"](spark, sf).select(shown).collect()))
    found = {r[0] for r in map(tuple, asked.select("query_id").collect())}
    assert got == [r for r in want if r[0] in found] and got
    ranked = engine.search(chunks, S.principals(spark), asked, S.DIM, rerank=lambda q, c: F.when(F.length(q) % 2 == 0, F.lit(2.0))).collect()
    assert {r["query_id"] for r in ranked} == {r[0] for r in got} and any(r["final_score"] > 1.5 for r in ranked)
