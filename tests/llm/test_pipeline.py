"""The pipeline's stages against plain Python, each on its predecessor's rows."""

import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from docgrain.llm import _shared  # noqa: E402
from docgrain.llm._pieces import tokenizer  # noqa: E402
from docgrain.llm.packing import binary_lengths  # noqa: E402

from . import data  # noqa: E402
from .test_operators import components, secrets  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(200 + i, " | ".join(data.prose(50 + i, 30).split()), "en", "s1", 1, *["c"] * 8) for i in range(6)]
    rows = [r for r in data.rows() if r[0] is not None]
    spark.createDataFrame([*rows, *junk], data.SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in (0, 6, 7, 8, 9, 10, 13)] + [(200, 0, 0), (201, 0, 0), (202, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = _shared.staged(stage(spark, docs, sf_dir))
        seen[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= {203, 204, 205} and {0, 6, 9} <= {r["doc_id"] for r in after}
    before, after = seen["exact_dedup"]
    first = {}
    for r in before:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in after} == {min(v)[1] for v in first.values()}
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in components([(r["doc_id"], r["text"] or "") for r in before]).items() if i == c}
    before, after = seen["secrets"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and not any(secrets(r["text"] or "") for r in after)
    assert {r["doc_id"]: r["text"] for r in after if not secrets(r["text"] or "")} .items() >= {r["doc_id"]: r["text"] for r in before if not secrets(r["text"] or "")}.items()
    before, after = seen["packing"]
    want = []
    for r in before:
        ids = np.array([*tokenizer(P.path("byte_bpe_50k.json")).encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n in binary_lengths(len(ids), 1024):
            want.append((r["doc_id"], at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after) == sorted(want)
    left = len(_shared.STAGED)
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).drop("sequence_id").collect())) == sorted(map(repr, docs.drop("sequence_id").collect()))
    assert len(_shared.STAGED) == left + 1  # the last stage's documents alone


def test_a_text_under_a_copy_s_id_stays(spark, tmp_path):
    path, text = str(tmp_path), data.prose(70, 60)
    rows = [(1, text + "  more"), (2, text.replace(" ", "") + "more"), (2, data.prose(71, 50)), (None, text + " more"), (None, data.prose(72, 50)), (3, data.near(70, 60, 1) + " more"), (3, data.prose(73, 50))]
    spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = _shared.staged(stage(spark, docs, path))
    want = [rows[i] for i in (0, 2, 4, 6)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in docs.collect()))) == sorted(map(str, want))
