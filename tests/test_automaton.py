"""Terms found by one automaton against plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docgrain.operators import automaton, recall


@pytest.mark.parametrize("bound", [1 << 20, 8])
def test_finds(spark, monkeypatch, bound):
    monkeypatch.setattr(automaton, "TERM_CHARS", bound)
    monkeypatch.setattr(automaton, "SENT_ROWS", 2)
    r = random.Random(1)
    texts = ["".join(r.choice("ab é并😀\n") for _ in range(r.randrange(30))) for _ in range(40)] + [None, "", "ababab"]
    terms = ["a", "ab", "bab", "并", "😀", "é并", "\n", "zz", "", None, "ab", "abab"]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, body string, term2 string")
    got = automaton.finds(rows, "body", spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(i, "kept", t, x.index(t) + 1) for i, x in enumerate(texts) if x for t in terms if t and t in x}
    assert got.columns == ["id", "term2", "term", "place"] and {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_no_terms(spark):
    rows = spark.createDataFrame([(1, "text")], "id long, body string")
    assert automaton.finds(rows, "body", spark.createDataFrame([], "term string")).collect() == []


def test_a_very_long_text(spark):
    text = F.concat(F.repeat(F.lit("plain words here "), 600_000), F.lit("needle one"))
    rows = spark.range(1).select("id", text.alias("body"))
    terms = spark.createDataFrame([("needle",), ("words",), ("absent",)], "term string")
    automaton.finds(rows.where("id < 0"), "body", terms).collect()
    began = time.time()
    assert {(r["term"], r["place"]) for r in automaton.finds(rows, "body", terms).collect()} == {("needle", 10_200_001), ("words", 7)}
    assert time.time() - began < 20


def test_substring_recall_of_codes(spark):
    chunks = spark.createDataFrame([(1, "See XYZ_1000 now", "h"), (2, "xyz-1000", None), (3, "nothing", "about xyz 1000"), (4, "xyz 9", "h"), (5, None, None)], "chunk_id long, content string, heading_path string")
    seen = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4, 5)] + [(1, 1)], "principal_id int, chunk_id long")
    asked = spark.createDataFrame([(7, 0, ["xyz-1000", "nothing"]), (8, 1, ["xyz-1000"]), (9, 0, [])], "query_id long, principal_id int, terms array<string>")
    got = recall.substring_recall(chunks, seen, asked, F.col("terms"))
    assert {tuple(r) for r in got.collect()} == {(7, 2, 1, 1), (7, 1, recall.MISS, 2), (7, 3, recall.MISS, 3), (8, 1, recall.MISS, 1)}
