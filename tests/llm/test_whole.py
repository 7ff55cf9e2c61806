"""Near-duplicates at another threshold than op10's, and rows without an id whose texts' hashes are half equal."""

import brute
import pytest
from pyspark.sql import functions as F

from thermalis.llm import neardup, substring, suffix


def test_stage_links_from_four_fifths(spark):
    w = [f"k{i}" for i in range(104)]
    near = [*w[:93], *(f"z{i}" for i in range(7))]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join([*w[:70], *(f"y{i}" for i in range(34))]))]
    a, b, c = (brute.shingles(t) for _, t in rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs, 80).collect()) == [1, 3]
    assert {r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1, 2, 3}


def test_stage_against_plain_python(spark):
    w = [f"k{i}" for i in range(400)]
    rows = [(100 * k + j, " ".join([*w[10 * k : 10 * k + 104 - j], *(f"z{k}_{j}_{i}" for i in range(j))])) for k in range(6) for j in range(0, 26, 4)]
    sets = {i: brute.shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    while True:
        new = {i: min(comp[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
        if new == comp:
            break
        comp = new
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in comp if comp[i] == i)


@pytest.fixture(scope="module")
def twins(spark):
    """Two texts whose 64-bit hashes are equal in the upper half."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(60)])
    tags = spark.range(400_000).select("id", F.shiftright(F.xxhash64(text), 32).alias("tag"))
    ids = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n = 2").orderBy("a").first()
    return [" ".join(f"w{k}x{i}" for k in range(60)) for i in (ids["a"], ids["b"])]


def test_texts_without_id_keep_their_own_marks(spark, twins):
    rows = [(None, twins[0]), (None, twins[1]), (1, twins[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.repeated_bytes(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeated_bytes([t for _, t in rows]))
    kept = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(((i, *r) for (i, _), r in zip(rows, brute.repeated_words(rows), strict=True)), key=str)


def test_texts_without_id_keep_their_own_links(spark, twins):
    rows = [(None, twins[0]), (None, twins[1]), (1, twins[0] + " tail"), (2, twins[1] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).select("n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.near_groups(rows))
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == [1, 2]
