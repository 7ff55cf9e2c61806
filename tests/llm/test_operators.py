"""The text operators against plain Python, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermalis.llm import common, decontaminate, mixing, neardup, quality, rangecoder, sharding, substring, suffix, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = ("id", "tag", "marks", "h", "size", "hash", "cover", "n_hit", "known", "seed", "_key", "_s", "target", "node", "part", "score")


def words(rng, n, kinds=4000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def thue_morse(n, letters="ab"):
    """Text and its complement have one polynomial hash modulo 2**64, whatever the base, from 1,024 letters on."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def corpus(seed=5):
    """Rows (doc_id, text, source): copies, near copies, shared passages, odd characters, nulls, repeated ids, one long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(60, 260)) for _ in range(25)]
    passage, other = words(rng, 90), words(rng, 55)
    texts = list(base)
    for b in base[:8]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), b, b + " tail"]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(6)] + [f"{other}\n{words(rng, 40)}", f"{words(rng, 9)}\t{other}", other]
    texts += [None, None, "", " \n\t", "one", "two words", "É ÀB Zz é", "a\x0bb\x0cc\rd", "日本語 テキスト " * 40, "ab " * 400, "x" * 500, "x" * 500, words(rng, 6000), "Null\x00byte " * 30]
    rows = [(i, t, f"s{rng.randrange(3)}") for i, t in enumerate(texts)]
    rows += [(None, base[3], None), (None, base[3], None), (3, base[4], "s1"), (3, base[4], "s1"), (-7, base[5], "s0"), (1 << 40, passage, "s2")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


def empty(docs):
    return docs.limit(0)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix(docs, rows):
    got = suffix.repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, [(i, *r) for (i, _, _), r in zip(rows, brute.repeated_bytes([t for _, t, _ in rows]), strict=True)])
    assert suffix.repeated_bytes(empty(docs)).count() == 0


def test_suffix_short_distances(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abc ") for _ in range(3000))
    texts = [a[i : i + 150 + 10 * k] + f"<{k}>" + a[j : j + 190 + k] for k, (i, j) in enumerate((rng.randrange(2500), rng.randrange(2500)) for _ in range(60))]
    got = suffix.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").drop("doc_id", "spans").collect()
    assert [tuple(r) for r in got] == brute.repeated_bytes(texts)


def test_substring(docs, rows):
    got = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    same(got, [(i, *r) for (i, _, _), r in zip(rows, brute.repeated_words([(i, t) for i, t, _ in rows]), strict=True)])
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_near_duplicates(docs, rows):
    got = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    same(got, [(i, *r) for (i, _, _), r in zip(rows, brute.near_groups([(i, t) for i, t, _ in rows]), strict=True)])
    assert neardup.near_duplicates(empty(docs)).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_near_duplicate_family(spark):
    """Many near copies that link in a chain, and as many that lie just below the threshold."""
    rng = random.Random(9)
    w = [f"k{i}" for i in range(400)]
    chain = [w[3 * k : 3 * k + 120] for k in range(40)]
    below = [[x if rng.random() > 0.03 else f"z{rng.random()}" for x in w[150:350]] for _ in range(60)]
    data = list(enumerate(" ".join(t) for t in chain + below))
    rng.shuffle(data)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = {i: c for (i, _), (_, c) in zip(data, brute.near_groups(data), strict=True)}
    assert got == want and len(set(want.values())) > 2


def test_block_step_decides_alone(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    test_near_duplicate_family(spark)


def test_large_bucket_without_links(spark, monkeypatch):
    """Texts that share a third of their shingles meet in buckets and do not link; the blocks hold few of them."""
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4000)
    rng = random.Random(21)
    shared = words(rng, 80)
    data = [(i, f"{shared} {words(rng, 40, 10**7)}") for i in range(120)]
    data += [(1000 + i, t + " end") for i, t in data[:20]]
    rng.shuffle(data)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(data, brute.near_groups(data), strict=True)}


def test_recall_of_links(spark):
    """Pairs at similarities around the threshold: no link that plain Python finds is lost."""
    rng = random.Random(33)
    data = []
    for k in range(150):
        w = words(rng, 120, 10**6).split()
        other = list(w)
        for at in rng.sample(range(120), rng.choice((1, 2, 3))):
            other[at] = f"z{rng.random()}"
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    want = {i for (i, _), (_, c) in zip(data, brute.near_groups(data), strict=True) if c != i}
    got = {r["doc_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).filter("not kept").collect()}
    assert 40 < len(want) < 150 and got == want


def test_shared_prompt_line(spark):
    """Many items share a line that one text holds many times: (item x place) is never laid out at once."""
    line = " ".join(f"p{i}" for i in range(11))
    items = [(i, f"{line} item {i} has its own words here and they go on for some time {i}") for i in range(400)]
    rows = [(1, f"{line}\n" * 400), (2, f"x {items[7][1]} y"), (3, line.upper()), (4, "nothing of it")]
    found = decontaminate.annotate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in found}
    assert got == {i: w[:3] for (i, _), w in zip(rows, brute.contamination([t for _, t in rows], items), strict=True)}
    by_item = {m["item"]: m["words"] for r in found if r["doc_id"] == 2 for m in r["matches"]}
    assert by_item["7"] == len(items[7][1].split()) and by_item["8"] == 12


def test_registers_estimate():
    rng = np.random.default_rng(2)
    grid = np.linspace(0.02, 1, 50)
    for j in (0.5, 0.85):
        n, shared = 4000, int(2 * 4000 * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = (neardup.registers(common.mixed(s))[None, :] for s in (x[:n], x[n - shared :]))
        size = np.array([float(n)])
        assert abs(grid[neardup.estimates(a, b, size, size, grid).argmax()] - j) < 0.15


def test_decontamination(spark, docs, rows):
    w = brute.ALNUM.findall(rows[0][1] or "lorem ipsum")
    clean = [t for _, t, _ in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(clean[0].split()[5:30])), (2, "one"), (20, clean[1].upper()[:300]), (3, None), (4, ""), (None, " ".join(clean[2].split()[:12])), (5, "two words"), (5, "not there at all"), (6, "x y z"), (7, "é ÀB"), (8, "none " * 12), (9, " ".join(w[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.annotate(docs, bench, ["doc_id"])
    got = found.select("doc_id", "n_words", "n_hit", F.size(F.array_distinct(F.array_compact("items"))).alias("k"), F.sha2(F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact("items")))).cast("binary"), 256)).collect()
    want = [(i, *r) for (i, _, _), r in zip(rows, brute.contamination([t for _, t, _ in rows], items), strict=True)]
    same(got, want)
    longest = found.select(F.explode("matches").alias("m")).select("m.*").filter("item = '1'").agg(F.max("words")).first()[0]
    assert longest == 25
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(r[2] == 0 for r in want)
    assert decontaminate.annotate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.annotate(empty(docs), bench).count() == 0


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    test_decontamination(spark, docs, rows)


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, rows):
    got = sharding.shard(docs, 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    same([tuple(r)[:5] + (r["grown_shard"],) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(i or 0, 16), jump(i or 0, 17)) for i, t, _ in rows])
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert sharding.shard(empty(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_jump_walk(spark, n):
    keys = [0, 1, -1, 12345, (1 << 63) - 1, -(1 << 63), 987654321987]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_walk(F.col("k"), n).alias("w")).collect()
    assert {r["k"]: (r["w"]["shard"], r["w"]["grown"]) for r in got} == {k: (jump(k, n), jump(k, n + 1)) for k in keys}


def water_fill(sizes, weights, total):
    """Targets by resharing the excess until none is above twice its size."""
    target, open_ = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[k] for k in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 2 * sizes[s] for s in above}
        open_ -= above


def test_mixing(docs, rows):
    size = lambda t: len(brute.SPACED.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got = mixing.mix(docs).collect()
    same([(r["doc_id"], r["size"], r["source"]) for r in got], [(i, size(t), s) for i, t, s in rows])
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s], abs=1e-4) and r["source_size"] == sizes[s] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        largest = {}
        for r in mine:
            largest[r["doc_id"]] = largest.get(r["doc_id"], 0) + r["size"]
        short = want[s] - sum(r["taken"] for r in mine)
        assert -1 <= short <= max(largest.values()) + 1
        # what is left is less than any row that could still be taken once more, unless rows are equal
        times = int(want[s] // max(sizes[s], 1))
        texts = [(i, t) for i, t, x in rows if x == s]
        left = [r["size"] for r in mine if r["size"] and r["taken"] == times * r["size"]]
        if times < 2 and left and len(set(texts)) == len(texts):
            assert short < min(left) + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix(empty(docs)).count() == 0 and mixing.take_mix(empty(docs)).count() == 0


def test_mixing_fills_what_a_long_row_leaves(spark):
    """A source that ends at a row far longer than what is left takes the shorter ones behind it: no row that is not taken still fits."""
    rng = random.Random(31)
    rows = [(i, words(rng, rng.choice((900, 40, 15, 3, 1))), f"s{i % 5}") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in range(5):
        mine = [r for r in got if r["doc_id"] % 5 == s]
        times = mine[0]["target"] // mine[0]["source_size"]
        left = [r["size"] for r in mine if r["taken"] == times * r["size"]]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < (min(left) if times < 2 else 1)


def test_mixing_without_words(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(d).collect()] == [(0.0, 0), (0.0, 0)]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_tokens(docs, rows, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    got = tokens.tokens_written(docs, tokenizer).orderBy("start").collect()
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [0])
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start
        crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r["doc_id"]] if len(x) == r["n_tokens"]]
        assert r["ids_crc32"] in crc
        start += r["n_tokens"]
    assert tokens.tokens_written(empty(docs), tokenizer).count() == 0


@pytest.mark.parametrize("text", ["It's  a test.\n\n  We'll see<|endoftext|> ok", "a\xa0b\x85c\x1cd", "ﬁ 日本 ½ ²³ naïve ÀÉ", "'s's 'll x'", "tabs\t\tand   spaces   ", "é ​ zero", "", " ", "\n\n a \t b  \n", "x² µm ¼ × ÷ ªº ¡hola! §5", "ΑΒΓ Ȁȿ ɐɑ", "12 34ab56 --!! a_b", "end  ", "­ soft ¬ ɏ"])
def test_pieces_equal_the_whole(tokenizer, text):
    from tokenizers import Tokenizer

    ids, n = tokens.Encoder(tokenizer).encode(pa.array([text, "plain words", None, text]))
    want = Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids + [0]
    assert n[0] == len(want) and ids[: n[0]].tolist() == want and ids[-n[3] :].tolist() == want and n[2] == 1


def test_pieces_beyond_what_is_remembered(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = random.Random(8)
    texts = [words(rng, 3000, 10**6), thue_morse(1024), None, thue_morse(1024, "ba"), words(rng, 500, 60), "x" * 5000 + "\u3000 y", words(rng, 3000, 10**6)]
    code, whole = tokens.Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    for _ in range(2):
        ids, n = code.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in [*whole.encode(t or "", add_special_tokens=False).ids, 0]] and n.sum() == len(ids)
    assert len(code.known) == 50


def test_range_coder():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 511, 512, 513, 2049, 9000, 600_001):
        for x in (rng.integers(0, 70_000, n), np.minimum(rng.pareto(0.5, n) * 4, 50000).astype(int), np.zeros(n, int), np.arange(n) % 3, rng.integers(0, rangecoder.LIMIT, n)):
            assert (rangecoder.decode(rangecoder.encode(x)) == x).all()
    for bad in (rangecoder.LIMIT, -1):
        with pytest.raises(ValueError):
            rangecoder.encode(np.array([bad]))
    repeats = rangecoder.encode(np.tile(rng.integers(0, 50000, 50), 200))
    assert len(repeats) < 4000


def test_range_coder_is_smaller_than_deflate(tokenizer):
    """On ids that follow Zipf's law, and on those of generated prose."""
    rng = np.random.default_rng(6)
    weights = 1 / np.arange(1, 20_001)
    zipf = rng.choice(20_000, 200_000, p=weights / weights.sum())
    prose = tokens.Encoder(tokenizer).encode(pa.array([words(random.Random(k), 2000) for k in range(40)]))[0]
    for ids in (zipf, prose):
        assert len(rangecoder.encode(ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_lessons_of_the_coder_are_counted_together(monkeypatch):
    ids, calls, count = np.arange(20 * rangecoder.LEAST_BLOCK) * 7 % 300, [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    coded = rangecoder.encode(ids)
    lessons = rangecoder.LEAST_BLOCK // (rangecoder.RUN * rangecoder.WEIGH)
    assert len(calls) <= 1 + 2 * lessons  # two counters a lesson, and the ids themselves; one pass a run would be 16 times that
    assert (rangecoder.decode(coded) == ids).all() and len(calls) <= 1 + 4 * lessons


def test_damaged_block_is_found():
    data = bytearray(rangecoder.encode(np.arange(5000) * 7 % 50000))
    data[len(data) // 2] ^= 64
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(data))
    with pytest.raises(ValueError):
        rangecoder.decode(b"something else")

def test_damage_stays_in_its_block():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.pareto(0.6, 6000) * 4, 50000).astype(int)
    clean = rangecoder.encode(ids)
    sizes = [(first, n) for first, n, _ in rangecoder.blocks(clean)]
    assert len(sizes) == 12 and sum(n for _, n in sizes) == 6000
    for place in range(len(clean) - 40, len(clean) - 2000, -97):  # the coded words of the blocks lie at the end
        data = bytearray(clean)
        data[place] ^= 0x55
        got = list(rangecoder.blocks(bytes(data)))
        lost = [first for first, _, own in got if own is None]
        assert [g[:2] for g in got] == sizes and len(lost) <= 2  # a byte may hold bits of two blocks' words
        assert all((own == ids[first : first + n]).all() for first, n, own in got if own is not None)
        if lost:
            with pytest.raises(ValueError, match="damaged"):
                rangecoder.decode(bytes(data))
    for place in (5, 13, 21, 60, 300):  # the head
        data = bytearray(clean)
        data[place] ^= 0x10
        got = list(rangecoder.blocks(bytes(data)))
        assert got[0] == (0, 0, None) and len(got) == 1
    cut = list(rangecoder.blocks(clean[:-700]))
    assert cut[0][2] is not None or cut[0] == (0, 0, None)


def test_a_damaged_chapter_leaves_the_others():
    rng = np.random.default_rng(6)
    ids = np.concatenate([rng.permutation(70_000), rng.permutation(70_000)])
    clean = rangecoder.encode(ids)
    first = int.from_bytes(clean[5:13], "little")
    data = bytearray(clean)
    data[5 + 20] ^= 1
    got = list(rangecoder.blocks(bytes(data)))
    assert got[0] == (0, 0, None) and first < len(clean) - 5 and all(own is not None for _, _, own in got[1:])
    assert sum(n for _, n, _ in got) > 30_000


def test_documents_beside_damage_are_read(spark, docs, tokenizer):
    path = common.shared_dir(spark)
    tokens.encode_documents(docs, tokenizer).coalesce(1).write.parquet(path)
    hurt = common.shared_dir(spark)

    def flip(batches):
        for b in batches:
            streams = [bytearray(s) for s in b.column("stream").to_pylist()]
            for s in streams:
                s[-20] ^= 0xFF
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names[:-1]), pa.array([bytes(s) for s in streams], pa.binary())], b.schema.names)

    whole = spark.read.parquet(path)
    whole.mapInArrow(flip, whole.schema).write.parquet(hurt)
    before = {tuple(r)[:3]: r["ids_crc32"] for r in tokens.read_tokens(spark, path).collect()}
    after = {tuple(r)[:3]: (r["ids_crc32"], r["ids"]) for r in tokens.read_tokens(spark, hurt, True, "null").collect()}
    lost = [k for k, (crc, ids) in after.items() if crc is None]
    assert after.keys() == before.keys() and 0 < len(lost) < len(before)
    assert all((crc is None) == (ids is None) and crc in (None, before[k]) for k, (crc, ids) in after.items())
    with pytest.raises(Exception, match="damaged"):
        tokens.read_tokens(spark, hurt).count()



def labelled(spark, n=600):
    """Clean prose, shouted junk (quality 0) and prose with abuse (toxic 1)."""
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        t = ". ".join(words(rng, 12, 900).capitalize() for _ in range(rng.randrange(3, 9)))
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split()[:20] * 3)
        if toxic:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilexa", "vilexo", "grubb"]))
            t = " ".join(w)
        out.append((i, t))
        if i % 3 != 2:
            labels.append((i, int(not bad), int(toxic)))
    out += [(None, None), (n, None), (n + 1, ""), (n, "again the same id")]
    labels += [(None, 1, 0), (n + 5, 0, 1), (3, None, None)]
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_quality(spark):
    docs, labels = labelled(spark)
    stats = common.written(quality.document_statistics(docs))
    got = quality.scores(stats, quality.fit(stats, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert auc([(r["score"], r["doc_id"] % 6 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]) > 0.98
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id < 600 and doc_id % 6 <> 0").count() >= 490
    assert {r["score"] for r in quality.scores(stats, quality.fit(stats, labels.limit(0))).collect()} == {0.5}
    assert quality.document_statistics(docs.limit(0)).count() == 0


def test_isotonic():
    x, level = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(level) >= 0).all() and len(x) < 5


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = toxicity.scores(docs, *toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], r["doc_id"] % 5 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert auc(held) > 0.98
    assert len(toxicity.scores(docs, *toxicity.fit(docs, labels.limit(0))).collect()) == docs.count()
    assert toxicity.scores(docs.limit(0), *toxicity.fit(docs.limit(0), labels)).count() == 0


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = labelled(spark)
    wrong = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, wrong)
    assert a[1] == b[1] and (a[0] == b[0]).all()


def test_words_of_rolling_hash():
    data, at = common.utf8(pa.array(["ab cd", None, "", "ab"]))
    starts, ends, first = common.word_bounds(~common.SPACE[data], at)
    assert first.tolist() == [0, 2, 2, 2, 3] and [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ab"]
    for h in (common.Rolling(common.BYTE_SYMBOLS[data]).slices(starts, ends), common.word_hashes(data, starts, ends)):
        assert h[0] == h[2] != h[1]
    assert len(common.word_hashes(data, starts[:0], ends[:0])) == 0


def made_to_collide():
    """Rows whose words, shingles and byte strings no polynomial hash modulo 2**64 tells apart."""
    a, b = thue_morse(4096), thue_morse(4096, "ba")
    rng = random.Random(12)
    lead, tail = words(rng, 60), words(rng, 60)
    texts = [a, b, f"{lead} {a} {tail}", f"{lead} {b} {tail}", " ".join(thue_morse(1100)), " ".join(thue_morse(1100, "ba")), f"x {a} y", a + " z"]
    return list(enumerate(texts))


def test_strings_made_to_collide(spark):
    rows = made_to_collide()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in suffix.repeated_bytes(docs).collect()}
    assert [tuple(found[i])[1:5] for i, _ in rows] == brute.repeated_bytes([t for _, t in rows])
    kept = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, kept)) == [(i, *r) for (i, _), r in zip(rows, brute.repeated_words(rows), strict=True)]
    near = neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, near)) == [(i, *r) for (i, _), r in zip(rows, brute.near_groups(rows), strict=True)]
    items = [(k, t) for k, (_, t) in enumerate(rows) if k in (0, 2, 4)]
    hits = decontaminate.annotate(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).select("doc_id", "n_words", "n_hit").collect()
    assert sorted(map(tuple, hits)) == [(i, *r[:2]) for (i, _), r in zip(rows, brute.contamination([t for _, t in rows], items), strict=True)]
