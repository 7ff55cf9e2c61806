"""The pipeline's stages against plain Python, each judged on its own input."""

import sys

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thermalis.llm import common

DATA = "/root/testdata/sf0.001"
sys.setrecursionlimit(10_000)


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, DATA, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], DATA)))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert set(stages[-1].columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_quality_keeps_good_documents(spark, stages):
    kept = {i for i, _ in pairs(stages[1])}
    labels = common.table(spark, DATA, "labels").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"] == 1], [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_one_of_each(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    groups = brute.near_groups(before, 80)
    assert sorted(after) == sorted(p for p, (_, c) in zip(before, groups, strict=True) if c == p[0])


def test_unseen(spark, stages):
    before, after = pairs(stages[2]), pairs(stages[3])
    items = [tuple(r) for r in common.table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    hits = brute.contamination([t for _, t in before], items)
    assert sorted(after) == sorted(p for p, h in zip(before, hits, strict=True) if h[1] == 0)


def test_mix_and_tokens(stages):
    before, after = pairs(stages[3]), pairs(stages[4])
    n = lambda ps: sum(len(brute.SPACED.findall(t)) for _, t in ps)
    assert n(after) == pytest.approx(1.5 * n(before), rel=0.2) and set(after) <= set(before)
    assert sorted(r["doc_id"] for r in stages[5].select("doc_id").collect()) == sorted(i for i, _ in after)


def odd_documents(spark, n):
    """Rows with nulls, empty and long texts, repeats, ids that repeat, and columns that stages use for themselves."""
    text = lambda k: " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(80))
    rows = [(None, None, "en", None, None), (1, None, "en", "a", 0), (2, "", "de", "a", 0), (3, " \n", "de", "b", 2), (4, text(4), "en", "a", 1), (4, text(4), "en", "a", 1), (5, text(4) + " end", "en", "b", 1), (None, text(6), None, None, 1), (6, text(7), "en", "b", 1), (6, text(8), "en", "b", 1), (7, " ".join(text(k) for k in range(300)), "en", "a", 1), (-8, text(9), "en", "a", 1)][:n]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "tag", "node", "score", "n_hit", "cover", "target", "part", "_row", "hash"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("n", [0, 12])
def test_stages_on_odd_documents(spark, name, stage, n):
    docs = odd_documents(spark, n)
    got = stage(spark, docs, DATA)
    if name.startswith("token"):
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((r["doc_id"] for r in docs.collect()), key=str)
        return
    assert got.columns == docs.columns
    before, after = docs.collect(), got.collect()
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    ids = [r["doc_id"] for r in after if r["text"] is not None]
    if not n:
        assert not after
    elif name.startswith("MinHash"):
        assert 5 not in ids and ids.count(4) == 2 and ids.count(6) == 2 and len(after) == n - 1
    elif name.startswith("benchmark"):
        assert len(after) == n


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[5].collect()))
