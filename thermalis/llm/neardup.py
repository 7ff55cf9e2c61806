"""Near-duplicate groups by SetSketch registers, banded, estimated jointly by likelihood, then verified.

A register is the minimum of exponential variates over a document's shingles, truncated to a power
of BASE (Ertl's SetSketch). Equal sets form one node first. Bands of register values give buckets.
Within a bucket, members are compared with one centre; after a few such rounds nearly all buckets
lie in one component. A bucket that does not is decided exactly in blocks, bounded in members and in
shingles, which give one row a member, never one a pair. So a group of k copies costs about k
comparisons, and yet no linked pair that shares a bucket is left undecided: a pair is passed over
only if it is in one component already. At similarity 0.85 a pair shares no bucket with probability
(1 - 0.85**4)**32, about 6e-11; at 0.8, about 5e-8.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
#: Similarity in per cent that links, unless another is asked for.
PERCENT = 85
#: Registers, registers of a band, base of the truncation, offset of the register values.
REGISTERS, BAND, BASE, ZERO = 128, 4, 1.02, 200
#: A pair is dropped unverified when its likelihood estimate lies this many standard deviations below the threshold.
DOUBT = 5.0
#: Rounds of comparison with a centre; expected members and shingles of a block afterwards.
ROUNDS, BLOCK, BLOCK_SHINGLES = 2, 512, 4 << 20
#: A null id counts as the largest.
LAST = (1 << 63) - 1
MULTIPLY = (C.splitmix(REGISTERS, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
ADD = (C.splitmix(REGISTERS, 5) >> np.uint64(32)).astype(np.uint32)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each text (the whole text, if it has fewer words), with repeats, and len + 1 offsets."""
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(~C.SPACE[data], at)
    symbols, n = C.word_hashes(data, starts, ends), np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends_ = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=ends_[1:])
    begin = np.arange(ends_[-1]) + np.repeat(first[:-1] - ends_[:-1], count)
    return C.sequences(symbols, begin, np.repeat(np.minimum(n, SHINGLE), count), SHINGLE), ends_


def registers(x: np.ndarray) -> np.ndarray:
    """The register values of a set of hashes, which is not empty."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * MULTIPLY + ADD).min(0), out=low)
    exponential = -np.log1p(-(low.astype(float) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + ZERO, 0, 65535).astype(np.uint16)


def _sketched(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            hashes, ends = shingles(data, at)
            n, node, regs = np.zeros(j - i, np.int64), [b""] * (j - i), [b""] * (j - i)
            for d in range(j - i):
                if ends[d] < ends[d + 1]:
                    s = np.unique(hashes[ends[d] : ends[d + 1]])
                    n[d], node[d], regs[d] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("tag").slice(i, j - i), pa.array(n), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], ["id", "tag", "n", "node", "regs"])


def _sets(batches):
    for b in batches:
        for i, j, data, at in C.chunks(b.column("text")):
            hashes, ends = shingles(data, at)
            sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array(sets, pa.binary())], ["node", "items"])


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-likelihoods (rows: pairs, columns: `at`) of the similarities `at`, given two rows of registers and the sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    j = np.minimum(at[None, :], np.minimum(u / v, v / u))
    high, low = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return up * np.log(np.maximum(high, tiny)) + down * np.log(np.maximum(low, tiny)) + (a.shape[1] - up - down) * np.log(np.maximum(1 - high - low, tiny))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow the threshold, and the maximum-likelihood estimate is not DOUBT deviations below it."""
    t = percent / 100
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    grid = np.linspace(0.02, 1, 50)
    if ok.any():
        best = grid[estimates(a[ok], b[ok], n_a[ok].astype(float), n_b[ok].astype(float), grid).argmax(1)]
        ok[ok] = best >= t - DOUBT * math.sqrt(t * (1 - t) / a.shape[1])
    return ok


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(C.utf8(column)[0].tobytes(), np.uint16).reshape(-1, REGISTERS)


def _plausible(batches, percent):
    for b in batches:
        if b.num_rows:
            yield b.filter(pa.array(plausible(_regs(b.column("regs")), _regs(b.column("regs2")), b.column("n").to_numpy(), b.column("n2").to_numpy(), percent))).select(["a", "b"])


def _linked(batches, percent):
    for b in batches:
        ok = []
        for s, t in zip(b.column("items").to_pylist(), b.column("items2").to_pylist(), strict=True):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) joined along edges (a, b): comp becomes the least comp that is reachable.

    Least label of the neighbours, then the label of the label, until nothing changes; each round
    is written to the shared folder.
    """
    own = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")).join(edges, "a")
    links = own.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").filter("ca != cb").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
    links = C.written(links.union(links.select("v", "u")).distinct())
    at = C.written(links.select(F.col("u").alias("k")).distinct().withColumn("to", F.col("k")))
    while True:
        near = links.join(at, links["v"] == at["k"]).groupBy("u").agg(F.min("to").alias("near"))
        hooked = at.join(near, at["k"] == near["u"]).select("k", F.least("to", "near").alias("to"), F.col("to").alias("was"))
        jump = hooked.select(F.col("k").alias("to"), F.col("to").alias("next"))
        new = C.written(hooked.join(jump, "to", "left").select("k", F.least("to", F.coalesce("next", "to")).alias("to"), "was"))
        at = new.select("k", "to")
        if not new.filter("to != was").limit(1).count():
            break
    return labels.join(at, labels["comp"] == at["k"], "left").select("node", F.coalesce("to", "comp").alias("comp"))


def split(held: DataFrame, sketches: DataFrame) -> DataFrame:
    """(bucket, node, comp, parts) of the buckets that lie in several components; parts: into how many blocks each is cut, by members and by their shingles."""
    size = held.join(sketches.select("node", "n"), "node")
    buckets = size.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter("lo != hi")
    parts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    return held.join(buckets.select("bucket", parts.alias("parts")), "bucket").select("bucket", "node", "comp", "parts")


def _block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Which members of one pair of blocks hang together by exact links: each with the first of its kind, so at most one row a member.

    All pairs are decided here, by products of the 0/1 matrices of the shingles that occur twice.
    """
    node, comp, block = (group[c].to_numpy() for c in ("node", "comp", "block"))
    sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
    size = np.array([len(x) for x in sets])
    kinds, which, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), size), np.flatnonzero(seen > 1)
    column = np.full(len(kinds), -1)
    column[shared] = np.arange(len(shared))
    column = column[which]
    both, step = np.zeros((len(sets), len(sets)), np.float32), max(1, (8 << 20) // len(sets))
    for c in range(0, len(shared), step):
        some = (column >= c) & (column < c + step)
        held = np.zeros((len(sets), min(step, len(shared) - c)), np.float32)
        held[owner[some], column[some] - c] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    if group["i"].iloc[0] != group["j"].iloc[0]:
        linked &= block[:, None] != block[None, :]
    linked |= comp[:, None] == comp[None, :]
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None, :], len(sets)).min(1)
        if (new == label).all():
            break
        label = new
    moved = comp[label] != comp
    return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, kept) of every row.

    component_id is the least id that is reachable over links of similarity `percent` or more (exact, on
    full sets); kept: whether it is the row's own. Rows without words link with nothing. A null id
    counts as the largest, and as a component id is null; rows with one id and equal sets are all
    kept or all not. tag is a hash of the text. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    sketched = C.written(rows.mapInArrow(_sketched, "id long, tag long, n long, node binary, regs binary"))
    nodes = C.written(sketched.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "tag", "n", "regs")).alias("m")).select("node", "m.*"))
    value = F.posexplode(F.array(*[F.substring("regs", 2 * BAND * k + 1, 2 * BAND) for k in range(REGISTERS // BAND)]))
    banded = nodes.select("node", value).select(F.xxhash64("pos", "col").alias("bucket"), "node")
    members = C.written(banded.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("k > 1"))
    candidates = members.select("node").distinct().join(nodes, "node")
    labels = C.written(candidates.select("node", F.col("node").alias("comp")))
    chosen = candidates.select("node", "id", "tag")
    sets = C.written(rows.join(chosen, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("node", "text").mapInArrow(_sets, "node binary, items binary"))
    sketches = nodes.select("node", "n", "regs")
    tested = None

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketches.withColumnRenamed("node", "a"), "a").join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("regs").alias("regs2")), "b").mapInArrow(partial(_plausible, percent=percent), "a binary, b binary")
        both = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items2")), "b")
        return C.written(both.mapInArrow(partial(_linked, percent=percent), "a binary, b binary"))

    for round_ in range(ROUNDS):
        in_bucket = members.select("bucket", "node").join(labels, "node")
        centre = F.min(F.struct(F.xxhash64("node", F.lit(round_)), F.col("node").alias("c"), F.col("comp").alias("cc"))).over(Window.partitionBy("bucket"))
        pairs = in_bucket.withColumn("m", centre).filter("comp != m.cc").select(F.least("node", "m.c").alias("a"), F.greatest("node", "m.c").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = C.written(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        labels = C.written(components(labels, verified(pairs)))
    held = split(members.select("bucket", "node").join(labels, "node"), sketches)
    block = F.pmod(F.xxhash64("node"), "parts").cast("int")
    dealt = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets, "node").select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "items")
    rest = dealt.groupBy("bucket", "i", "j").applyInPandas(lambda group: _block_links(group, percent), "a binary, b binary")
    labels = C.written(components(labels, C.written(rest.distinct())))
    least = labels.join(nodes.select("node", "id"), "node").withColumn("component", F.min("id").over(Window.partitionBy("comp"))).select("node", "component")
    named = nodes.select("node", "id").join(least, "node", "left").select("node", F.coalesce("component", "id").alias("component"))
    out = sketched.select("id", "tag", "n", "node").join(named, "node", "left").withColumn("component", F.coalesce("component", "id"))
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(null("id").alias("doc_id"), "tag", F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, that stay: one id of each group at that similarity. Rows equal in id and text stay or go together."""
    found = near_duplicates(docs, percent=percent).filter("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("tag").alias("_tag")).distinct()
    here = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_tag"))
    return here.join(found, ["_id", "_tag"], "left_semi").select("_row.*")


def op10_minhash_setsketch(spark, sf_dir):
    return near_duplicates(C.table(spark, sf_dir, "documents")).drop("tag")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e USING (a))
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a) USING (doc_id)
"""
