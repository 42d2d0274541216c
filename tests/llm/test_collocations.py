"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docgrain.llm import collocations

SCHEMA = "doc_id long, text string, lang string, block string, code string, n string"


def plain(rows, longest, least, scale, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in cand.items():
        holders = [b for (x, h), b in cand.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * b >= percent * a for b in holders):
            continue
        score, k = min((scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def texts(seed, rows):
    r = random.Random(seed)
    few = ["Alpha", "beta", "γάμμα", "d-e", "x’y", "O"]
    return [("".join(r.choice(few) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(0, 60))), r.choice(["en", "fr", None])) for _ in range(rows)]


@pytest.mark.parametrize("block, held, piece", [(1 << 19, 1 << 22, 1 << 21), (7, 1 << 22, 40), (50, 20, 10), (2, 1, 1)])
@pytest.mark.parametrize("longest", [2, 4, 5])
def test_against_plain(spark, monkeypatch, block, held, piece, longest):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "HELD_WORDS", held)
    monkeypatch.setattr(collocations, "SLICE_BYTES", piece)
    rows = texts(longest, 60) + [(None, "en"), ("", None), (" . , ", "fr"), ("same same same same same same same", "de"), ("same " * 9, "de"), ("gap . ", None)]
    rows += [rows[3]] * 3
    docs = spark.createDataFrame([(i, t, lang, "a", "b", "c") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(2)
    got = collocations.mine(docs, longest=longest, least=4, percent=60, top=15)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(rows, longest, 4, 2_000_000, 60, 15)


def test_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rows = texts(9, 80)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.mine(docs, least=3, top=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 3, 2_000_000, 80, 50)


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).collect() == []


def test_exact_beyond_64_bits(spark):
    wide = collocations.pair_grams(spark.createDataFrame([(1, 1, 1, 9 * 10**15)], "id long, left long, right long, f long"), spark.createDataFrame([(1, "en", "a", "a", 9 * 10**15 + 1, [], [])], "id long, lang string, phrase string, last string, f long, heads array<long>, tails array<long>"))
    row = wide.collect()[0]
    assert (row["phrase"], row["heads"], row["tails"]) == ("a a", [9 * 10**15 + 1], [9 * 10**15 + 1])
    cut = wide.selectExpr(collocations.worst_cut(2_000_000) + " AS cut").collect()[0]["cut"]
    assert cut["score"] == 2_000_000 * 9 * 10**15 // (2 * (9 * 10**15 + 1))


def joined_rows(spark, first):
    """Rows that the joins of SQL executions from number `first` on have made."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(runs.size())):
        if run.executionId() < first:
            continue
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_blocks_do_not_join_their_pairs(spark, monkeypatch):
    """Each of 200 blocks has all 64 pairs of eight words: joins make rows for a block's words and for grams, none for a block's pairs."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 300)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1)
    r = random.Random(3)
    rows = [(" ".join(r.choices("abcdefgh", k=300)), "en") for _ in range(200)]
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1) + 1
    got = collocations.mine(spark.createDataFrame(rows, "text string, lang string").coalesce(1), longest=3, top=50).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 30, 2_000_000, 80, 50)
    assert 200 * 8 <= joined_rows(spark, first) < 200 * 64 / 2


@pytest.mark.parametrize("most", [1, 3])
def test_full_sieve_changes_no_result(spark, monkeypatch, most):
    """A sieve with far too few words lets infrequent grams pass, which are counted and dropped."""
    monkeypatch.setattr(collocations, "SIEVE_WORDS", most)
    rows = texts(11, 80)
    got = collocations.mine(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=5, percent=70, top=60)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 5, 2_000_000, 70, 60)


def test_sieve_keeps_its_grams_and_few_others(spark):
    r = np.random.default_rng(5)
    ids = np.unique(r.integers(1, 1 << 40, (20_000, 3)), axis=0)
    words = collocations.sieve(spark.createDataFrame([(x,) for x in ids.tolist()], "id array<long>"), 3).value

    def passed(grams):
        place, bits = collocations.sieve_places(list(grams.T), len(words))
        return (words[place] & bits == bits).mean()

    assert passed(ids) == 1 and passed(r.integers(1, 1 << 40, (20_000, 3))) < 0.05 and passed(ids[:, ::-1]) < 0.05
