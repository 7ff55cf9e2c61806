"""The classifiers against plain Python, odd rows, and the contracts of all ten queries."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermalis.llm import common, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"
SCORED = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
CONTRACTS = {
    "op1_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_jump_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_toxicity_pu": SCORED,
    "op6_quality_classifier": SCORED,
    "op7_media_gif": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_minhash_setsketch": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_importance": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns_of_the_contract(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    docs = common.table(spark, DATA, "documents")
    if name.startswith(("op11", "op12")):  # a row a piece, and a row a pair or term
        assert got.count() >= docs.select("lang", "source").distinct().count()
    elif name.startswith(("op5", "op6")):
        rows = got.collect()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.5 if name[2] == "5" else 0.3)) for r in rows)
        assert len(rows) == docs.count()
    else:
        assert got.count() == docs.count()


def plain_nnpu(words, positive, prior):
    """Non-negative PU risk of a linear model over the given words, by Adam, one row at a time."""
    used = sorted({w for ws in words for w in ws})
    w, bias = dict.fromkeys(used, 0.0), math.log(prior / (1 - prior))
    m, v = [0.0] * (len(used) + 1), [0.0] * (len(used) + 1)
    p, u = [i for i, y in enumerate(positive) if y], [i for i, y in enumerate(positive) if not y]
    for step in range(1, toxicity.STEPS + 1):
        z = [sum(w[k] for k in ws) + bias for ws in words]
        s = [1 / (1 + math.exp(-x)) for x in z]
        loss = [math.log1p(math.exp(x)) for x in z]  # of calling the row negative
        risk = sum(loss[i] for i in u) / len(u) - prior * sum(loss[i] for i in p) / len(p)
        g = [0.0] * len(words)
        for i in p:
            g[i] = (prior * (s[i] - 1) - prior * s[i]) / len(p) if risk >= 0 else prior * s[i] / len(p)
        for i in u:
            g[i] = s[i] / len(u) if risk >= 0 else -s[i] / len(u)
        grad = [sum(g[i] for i, ws in enumerate(words) if k in ws) + toxicity.DECAY * w[k] for k in used] + [sum(g) + toxicity.DECAY * bias]
        for k, d in enumerate(grad):
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            change = toxicity.RATE * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if k < len(used):
                w[used[k]] -= change
            else:
                bias -= change
    return w, bias


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_training_against_plain_python(prior):
    rng = random.Random(2)
    words = [sorted(rng.sample(range(8), 3) + ([8] if k < 12 else [9] * (k % 3 == 0))) for k in range(40)]
    words = [sorted(set(x)) for x in words]
    positive = np.array([k < 12 for k in range(40)])
    got, bias = toxicity.train([np.array(x, np.int32) for x in words], positive, 10, prior)
    want, want_bias = plain_nnpu(words, positive.tolist(), prior)
    assert bias == pytest.approx(want_bias, abs=1e-6) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert prior > 0.5 or got[8] > max(got[k] for k in range(8))


def plain_words(text):
    """What word_sets() stands for: whole words of letters and their first 4, 5 and 6 bytes, lower-cased."""
    words = {w.encode() for w in re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))}
    return {("word", w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) > n}


def test_word_sets_are_sets_of_words_and_beginnings():
    texts = ["Vilexa vilexa VILEXAS", "", None, "a1b é日本 étude abcdefg", "x" * 50]
    data, at = common.utf8(pa.array(texts))
    words, ends = toxicity.word_sets(data, at)
    got = [set(words[s:e].tolist()) for s, e in zip(ends, ends[1:], strict=False)]
    want = [plain_words(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]  # no two of these few collide
    number = {}
    for g, w in zip(got, want, strict=True):
        for other, its in zip(got, want, strict=True):
            assert len(g & other) == len(w & its)
        number |= dict.fromkeys(g)
    assert len(number) == len(set().union(*want))


def test_words_are_chosen_from_all_documents(spark, monkeypatch):
    """A word that a few of many positives hold has a weight although no sample has it, and a common one has none."""
    monkeypatch.setattr(toxicity, "POSITIVES", 60)
    monkeypatch.setattr(toxicity, "UNLABELLED", 120)
    rng = random.Random(7)
    prose = lambda: " ".join(rng.choice(["stone", "river", "light", "field"]) for _ in range(12))
    rows = [(i, prose() + (" grubbo" if i % 3 == 0 else "") + (" rarius" if i % 120 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)], "doc_id long, toxic int")
    counts, n = toxicity.document_counts(docs)
    assert n == 3000 and counts.max() <= 3000
    weights, _ = toxicity.fit(docs, labels)
    of = lambda w: set(toxicity.word_sets(*common.utf8(pa.array([w])))[0].tolist())
    used = set(toxicity.choose(*toxicity.document_counts(docs.filter("doc_id % 3 = 0")), counts, n).tolist())
    assert of("grubbo") <= used and of("rarius") <= used and not of("stone") & used
    assert all(weights[k] > 0 for k in of("grubbo"))


def test_rows_of_one_id_part_in_the_samples(spark):
    """Thousands of different texts of one id are dealt to all bags, and a third of the rows without an id does not stop the fit."""
    rows = [(None if i % 3 == 0 else 4 if i % 3 == 1 else i, f"word{i} river") for i in range(1500)] + [(i, f"vilexa {i}") for i in range(5000, 5040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i in [4, *range(5000, 5040)]], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, weights, bias).collect()}
    assert min(got[i] for i in range(5000, 5040)) > max(got[4], got[None])


def test_isotonic_against_its_closed_form():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, x = rng.integers(1, 9, 12).astype(float), np.arange(12.0)
        ones = np.array([rng.integers(0, int(k) + 1) for k in n], float)
        knots, levels = quality.isotonic(x, n, ones)
        mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: B023, E731
        fitted = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        pools = sorted(set(np.round(fitted, 12)))
        assert len(knots) == len(levels) and (np.diff(levels) >= -1e-12).all() and len(pools) <= len(levels)


def odd(spark):
    rng = random.Random(1)
    prose = lambda k: " ".join(rng.choice(["the", "of", "stone", "river", "light", "over", "field"]) for _ in range(k))
    rows = [(i, prose(30) + (" vilexa grubb" if i % 4 == 0 else "")) for i in range(80)]
    rows += [(None, None), (80, None), (81, ""), (82, " \n"), (83, prose(40_000)), (5, rows[5][1]), (5, rows[5][1]), (5, "another text")]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)] + [(5, 1, 0), (None, 1, 1), (999, 0, 1), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("bag", "positive", "copy", "words", "score", "stats", "fold", "y", "quality", "toxic"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = odd(spark)
    stats = common.written(quality.document_statistics(docs))
    model = quality.fit(stats, labels)
    weights = toxicity.fit(docs, labels)
    for got in (quality.scores(stats, model), toxicity.scores(docs, *weights)):
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (None, 80, 81)}) == 1  # null as empty
    for nothing in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")).withColumn("quality", F.lit(None).cast("int"))):
        assert {r["score"] for r in toxicity.scores(docs, *toxicity.fit(docs, nothing)).collect()} == {0.5}
    without = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))
    assert all(r["score"] < 0.05 for r in toxicity.scores(docs, *without).collect())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_ridge_against_one_solve(spark):
    docs, labels = odd(spark)
    stats = common.written(quality.document_statistics(docs))
    model = quality.fit(stats, labels)
    rows = stats.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").filter(~common.held_out(F.col("doc_id")) & F.col("y").isNotNull()).collect()
    x = model.features(np.array([r["stats"] for r in rows], float))
    y = np.array([r["y"] for r in rows], float)
    want = np.linalg.solve(x.T @ x + quality.RIDGE * max(len(x), 1) * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(x @ model.weights, x @ want, atol=1e-6)
