"""Plans over whole tables without an oracle in SQL, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as T
from docgrain.operators import lexicon
from docgrain.plans import registry

PLANS = registry.queries()
PLANTED = [
    "x " * 900 + "See XYZ-1000, also xyz1000 and ax 30.",
    "使用：访问令牌（AccessToken）登录, AccessToken（访问令牌） 与 AppRouter(应用路由)",
    "y " * 900 + "id 510123199001011234. card 6222021234567890 call 13812345678 now 12345678901234567890",
]


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """The documents of the test tables, three of them with planted texts."""
    path = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").limit(3).collect()]
    text = F.col("text")
    for i, t in zip(ids, PLANTED):
        text = F.when(F.col("doc_id") == i, F.lit(t)).otherwise(text)
    docs.withColumn("text", text).write.parquet(f"{path}/documents.parquet")
    return path


def test_ag21_document_terms(spark, planted):
    freq, aliases = Counter(), defaultdict(set)
    for r in spark.read.parquet(f"{planted}/documents.parquet").collect():
        pairs = [(m[1], [m[2]]) for m in re.finditer(lexicon.CJK_FIRST, r["text"], re.A)] + [(m[2], [m[1]]) for m in re.finditer(lexicon.ASCII_FIRST, r["text"], re.A)]
        for m in re.finditer(T.MODEL_CODE, r["text"].lower(), re.A):
            term = re.sub(r"^([a-z]+)[-_ ]?(\d+)$", r"\1-\2", m[0], flags=re.A)
            pairs.append((term, [term.replace("-", ""), term.replace("-", " ")]))
        for term, names in pairs:
            freq[r["source"], term] += 1
            aliases[r["source"], term] |= set(names)
    want = {(*k, ",".join(sorted(aliases[k])), n) for k, n in freq.items() if n >= 2}
    assert {tuple(r) for r in PLANS["ag21_document_terms"](spark, planted).collect()} == want
    assert {"xyz-1000", "访问令牌"} <= {t for _, t, _, _ in want}


def test_tx18_masked_texts(spark, planted):
    def masked(text):
        for digits, head, stars, tail in ((r"\d{17}[\dXx]", 6, 8, 4), (r"\d{15}", 6, 6, 3), (r"\d{19}", 6, 8, 4), (r"\d{16}", 6, 4, 4), (r"1[3-9]\d{9}", 3, 4, 4)):
            text = re.sub(rf"(?<!\d){digits}(?!\d)", lambda m: m[0][:head] + "*" * stars + m[0][-tail:], text, flags=re.A)
        return text

    rows = spark.read.parquet(f"{planted}/documents.parquet").collect()
    want = {(r["doc_id"], hashlib.md5(masked(r["text"]).encode()).hexdigest()) for r in rows}
    assert {tuple(r) for r in PLANS["tx18_masked_texts"](spark, planted).collect()} == want
    assert sum(masked(r["text"]) != r["text"] for r in rows) >= 1 and "138****5678" in masked(PLANTED[2])
