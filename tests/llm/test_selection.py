"""Packing, source divergence and importance resampling against plain Python, on odd rows too."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thermalis.llm import divergence, importance, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use for their own columns.
CLASH = ("row", "g", "piece", "start", "offset", "run", "sources", "ns", "rank", "score", "weight", "_k", "_k0", "_at", "_part", "term", "total")


def words(rng, n, kinds=300):
    return " ".join(f"{rng.choice('abcdeé')}{'xyzäß日'[rng.randrange(kinds) % 6]}{'pq' * (rng.randrange(kinds) % 7)}" for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = [(i, words(rng, rng.choice((1, 5, 25, 60, 200, 900))), rng.choice(("en", "de", "")), rng.choice(("s0", "s1", "s2", "s2", "s2"))) for i in range(120)]
    rows += [(200, None, "en", "s0"), (201, "", "de", None), (202, " \n", None, "s1"), (203, "One WORD", "xx", "alone"), (204, words(rng, 9000), "en", "s1"), (205, "é" * 3000, "en", "s1"), (206, "Null\x00byte " * 30, "en", "s1")]
    rows += [(None, rows[3][1], "en", None), (None, rows[3][1], "en", None), (7, rows[7][1], "de", "s0"), (7, rows[7][1], "de", "s0"), (-5, rows[5][1], "de", "s0"), (1 << 40, rows[5][1], "de", "s0")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


def key(r):
    return tuple((x is not None, x) for x in r)


def check_packing(rows, found, size, end):
    """Every id is in one place, sequences have no gaps and none is too long; the number of sequences."""
    encode = Tokenizer.from_file(PATH).encode
    want = []
    for i, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, end]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("group", [10_000, 16])
def test_packing(docs, rows, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    found = packing.pack(docs, PATH, size=256).collect()
    plain = [(i, t) for i, t, _, _ in rows]
    used = check_packing(plain, found, 256, packing.END)
    total = sum(r["length"] for r in found)
    least = max(-(-total // 256), sum(r["length"] > 128 for r in found))
    assert used <= least + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packed_sequences_hold_the_ids(docs, rows):
    sequences = packing.sequences(packing.pack(docs, PATH, size=128, with_ids=True)).collect()
    encode = Tokenizer.from_file(PATH).encode
    assert sum(r["length"] for r in sequences) == sum(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)
    assert all(len(r["ids"]) == r["length"] == sum(r["lengths"]) and len(r["doc_ids"]) == len(r["lengths"]) for r in sequences)
    alone = next(r for r in sequences if r["doc_ids"] == [203] or 203 in r["doc_ids"])
    at = sum(alone["lengths"][: alone["doc_ids"].index(203)])
    assert alone["ids"][at : at + alone["lengths"][alone["doc_ids"].index(203)]] == [*encode("One WORD", add_special_tokens=False).ids, 2]


def test_search_empties_bins_and_keeps_every_piece():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(250, 450, 400), rng.integers(1, 1025, 300), np.full(50, 600), np.array([1024]), rng.choice([171, 341, 342, 512, 513], 300)):
        bins, gaps = packing.best_fit(lengths, 1024)
        packed = packing.pack_lengths(lengths)
        fill = np.bincount(packed, lengths)
        assert fill.max() <= 1024 and fill.min() > 0 and len(fill) <= len(gaps)
    # 10 = 5+5, 4+3+3, 4+3+3: best fit by falling length takes 4+4 and needs a fourth
    tight = np.array([5, 4, 4, 3, 3, 3, 3, 5])
    assert packing.best_fit(tight, 10)[0].max() == 3 and packing.pack_lengths(tight, 10).max() == 2


@pytest.mark.parametrize(
    "lengths, bins, fills",
    [
        ([5, 3, 2], [0, 1, 1], [10]),  # moves
        ([5, 4, 5, 1], [0, 0, 1, 1], [5, 10]),  # 1 moves
        ([4, 5, 3, 3], [0, 0, 1, 1], [5, 10]),  # two for one
        ([3, 2, 4, 6], [0, 0, 0, 1], [5, 10]),  # one for two
        ([4, 5, 6], [0, 0, 1], [5, 10]),  # one for one
    ],
)
def test_every_kind_of_step(lengths, bins, fills):
    lengths, bins = np.array(lengths), np.array(bins)
    gaps = (10 - np.bincount(bins, lengths)).astype(int).tolist()
    out = packing.Search(lengths, bins, gaps, 10).run(bins, 1)
    assert sorted(f for f in np.bincount(out, lengths).tolist() if f) == fills


def test_steps_raise_squared_fill():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = rng.integers(1, 60, 40)
        bins = np.arange(40) // 2
        gaps = (140 - np.bincount(bins, lengths)).astype(int).tolist()
        search = packing.Search(lengths, bins, gaps, 140)
        before = (np.bincount(search.bin, search.length) ** 2).sum()
        for b in range(20):
            while search.members.get(b) and search.step(b):
                after = (np.bincount(search.bin, search.length) ** 2).sum()
                assert after > before and np.bincount(search.bin, search.length).max() <= 140
                before = after


def test_trie_walks_in_byte_order_and_counts():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 6))).encode() for _ in range(3000)]
    trie, want = divergence.Trie(), {}
    for i in range(0, len(terms), 100):
        some = sorted(set(terms[i : i + 100]))
        number = np.arange(len(some)).repeat(2)
        source, n = np.tile([0, i % 3 + 1], len(some)), np.arange(2 * len(some)) + 1
        trie.add(some, number, source, n, np.ones(len(n), np.int64))
        for t, s, k in zip(number.tolist(), source.tolist(), n.tolist(), strict=True):
            a = want.setdefault((some[t], s), [0, 0])
            a[0] += k
            a[1] += 1
    names, counters = trie.leaves()
    assert names == sorted(set(terms))
    assert {(names[t], s): [n, d] for t, s, n, d in counters.T.tolist()} == want


def test_shares_are_exact():
    for counts, total, terms in (([0], 0, 1), ([0, 1, 7, 10**9, 10**13, 3 * 10**15, 4 * 10**15], 4 * 10**15, 10**6), ([0, 77, 12345], 12345, 77)):
        assert divergence.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]


@pytest.mark.parametrize("small", [False, True])
def test_divergence(docs, rows, monkeypatch, small):
    if small:  # blocks, runs and tries of a few rows
        for name, value in dict(BLOCK=2, RUN=3, LEAVES=40, GIVEN=5, ROUND_BYTES=2000).items():
            monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(docs, least=4, top=6)
    plain = [(lang, s, t) for _, t, lang, s in rows]
    want = brute.divergence(plain, 4, 6)
    assert {r[2] for r in want} == {"pair", "term"} and sorted(map(tuple, got.collect())) == sorted(want)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_without_terms(spark):
    docs = spark.createDataFrame([("en", "b", "x"), ("en", "a", None), ("en", None, "1 2 3"), ("fr", "a", "y")], "lang string, source string, text string")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == sorted(brute.divergence([tuple(r) for r in docs.collect()])) and len(got) == 6


def test_divergence_of_many_documents(spark):
    rng = random.Random(4)
    rows = [("en", f"s{rng.randrange(9) ** 2 % 7}", " ".join(rng.choice(("the", "The", "of", "é", "zé", "日本")) + rng.choice(("", "1", ".")) for _ in range(12))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == sorted(brute.divergence(rows))


@pytest.mark.parametrize("runs", [1, 3])
def test_importance(spark, docs, rows, runs):
    target = [words(random.Random(5), 50, 40), None, ""]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(map(tuple, importance.resample(docs, benchmark, runs=runs, percent=30).collect()), key=key)
    want = sorted(brute.importance([r[:2] for r in rows], target, runs, percent=30), key=key)
    assert got == want
    assert importance.resample(docs.limit(0), benchmark).count() == 0
    nothing = importance.resample(docs, benchmark.limit(0), percent=0).collect()
    assert len(nothing) == len(rows) and all(r["rank"] is None for r in nothing)


def test_drawn_rows_keep_their_columns(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30), "c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    drawn = importance.draw(docs, docs.limit(5), percent=20)
    assert sorted(drawn.columns) == sorted(docs.columns) and drawn.count() == 12


def test_radix_selection_against_sorting(spark):
    rng = random.Random(7)
    values = [(rng.choice((-(2**63), -5, 0, 3, 2**40, 2**63 - 1)), k) for k in range(500)]
    table = spark.createDataFrame(values, "a long, b long").repartition(4)
    keys = [F.col("a"), F.col("b")]
    for k in (1, 2, 77, 250, 499, 500):
        for digit in (4, 16):
            last = importance.select_least(table, keys, k, digit)
            assert sorted(map(tuple, table.filter(importance._not_above(keys, last)).collect())) == sorted(values)[:k]
    ranked = importance.ranked(table, keys).collect()
    assert [(r["a"], r["b"]) for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(values) and sorted(r["rank"] for r in ranked) == list(range(1, 501))
