"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from docgrain.llm import resampling

from . import data

SCHEMA = "doc_id long, text string, rank string, weight string, score string, digest string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text, n):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n, buckets, percent, least, seed):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, t, [code(f) for f in features_of(t, n)]) for i, t in docs]
    s, t = Counter(b for *_, x in found for b in x), Counter(code(f) for x in target for f in features_of(x, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, text, x in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in x)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text)) >= least])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("n, size", [(1, 1 << 18), (1, 90), (3, 90), (2, 7)])
def test_against_plain(spark, monkeypatch, n, size):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", size)
    monkeypatch.setattr(resampling, "RUN_ROWS", 4)
    texts = [(i, data.prose(i, 5 + 7 * i % 60) + (" Ärger, naïve-x9 " * (i % 3))) for i in range(40)] + [(41, None), (42, ""), (43, " .,\n"), (44, "x" * 500), (None, data.prose(3, 50)), (7, data.prose(99, 40))]
    texts += [texts[5], texts[5], texts[9]]
    target = [data.prose(1, 30), None, "", data.prose(2, 200)]
    docs = spark.createDataFrame([(*x, "a", "b", "c", "d") for x in texts], SCHEMA).repartition(3)
    out = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=500, percent=30, min_words=9)
    assert got(out) == plain(texts, target, n, 500, 30, 9, "2024")


def test_chunks_own_each_start_once():
    text = ("ab cde  f " * 40 + "g" * 70 + " hi").encode()
    whole = text.split()
    for size in (1, 9, 64, 5000):
        for carry in (0, 1, 3):
            parts = list(resampling.cut(text, size, carry))
            assert [w for words, own in parts for w in words[:own]] == whole
            starts = 0
            for words, own in parts:
                starts += own
                assert words[own:] == whole[starts : starts + carry]


def test_edges(spark):
    docs = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("some text",)], "text string")
    assert resampling.resample(docs, target).collect() == []
    few = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [(r["n_features"], r["rank"]) for r in resampling.resample(few, target).collect()] == [(2, None)]
    same = spark.createDataFrame([(i, data.prose(1, 40)) for i in (1, 2, 3)], "doc_id long, text string")
    none = resampling.resample(same, target.limit(0), percent=100)
    assert sorted(r["rank"] for r in none.collect()) == [1, 2, 3]
