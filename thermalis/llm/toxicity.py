"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all documents are the unlabelled set; no row counts as a
negative. Which words can have a weight is decided from how many of all positives and of all documents hold them. The risk
estimator corrects the unlabelled risk by the class prior and is kept from falling below zero (Kiryo et al.). Several
linear classifiers on hashed words are trained side by side, each in one task on bounded samples of both, which
serve the gradient steps alone, and averaged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hash space of the words; rows sampled for the gradient steps (expected, by a hash of id and text) as positives and as unlabelled.
WORD_BITS, POSITIVES, UNLABELLED = 18, 8_000, 24_000
#: Lengths in bytes of the word beginnings that count as features beside whole words: endings vary.
PREFIXES = (4, 5, 6)
#: Classifiers; positives that a feature needs to have a weight, and the standard
#: deviations by which they must exceed what the unlabelled set leads one to expect.
BAGS, SEEN, SURPRISE = 4, 3, 5.0
STEPS, RATE, DECAY = 150, 0.1, 1e-5
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SALT = 0x7078


def word_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed words and word beginnings of each text, end to end, and len + 1 offsets."""
    starts, ends, first = C.word_bounds(LETTER[data], at)
    rolling, doc = C.Rolling(C.BYTE_SYMBOLS[C.LOWER[data]]), np.repeat(np.arange(len(at) - 1), np.diff(first)).astype(np.uint64) << np.uint64(WORD_BITS)
    shift = np.uint64(64 - WORD_BITS)
    keys = [rolling.slices(starts, ends) >> shift | doc]
    for n in PREFIXES:
        longer = ends - starts > n
        keys.append(C.mixed(rolling.slices(starts[longer], starts[longer] + n) + np.uint64(n)) >> shift | doc[longer])
    key = np.sort(np.concatenate(keys))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32), np.searchsorted(key >> np.uint64(WORD_BITS), np.arange(len(at), dtype=np.uint64))


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows hold each hashed word, and how many rows there are: sums of one array a task, so 2**WORD_BITS numbers reach the driver at most."""
    size = 1 << WORD_BITS

    def count(batches):
        total, rows = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for _, _, data, at in C.chunks(b.column(0)):
                words, _ = word_sets(data, at)
                total[:size] += np.bincount(words, minlength=size)
                rows += len(at) - 1
        total[size] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out[:size], int(out[size])


def choose(positive: np.ndarray, positives: int, all_: np.ndarray, rows: int) -> np.ndarray:
    """The hashed words that more positives hold than chance allows, given how many of all rows hold them."""
    expected = all_ * (positives / max(1, rows))
    return np.flatnonzero((positive >= SEEN) & (positive - expected >= SURPRISE * np.sqrt(expected + 0.5)))


def _featured(used: np.ndarray):
    """The function that gives each row's chosen words, as their places in `used`."""
    where = np.full(1 << WORD_BITS, -1, np.int32)
    where[used] = np.arange(len(used), dtype=np.int32)

    def featured(batches):
        for b in batches:
            for i, j, data, at in C.chunks(b.column("text")):
                words, ends = word_sets(data, at)
                place = where[words]
                upto = np.append(0, np.cumsum(place >= 0))[ends]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("bag", "positive")), pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(place[place >= 0]))], ["bag", "positive", "words"])

    return featured


def train(words: list[np.ndarray], positive: np.ndarray, used: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of `used` words and a bias, by Adam on the non-negative risk with the logistic loss. words: the numbers of those that each row holds."""
    flat, row = (np.concatenate(words) if len(words) else np.empty(0, np.int32)), np.repeat(np.arange(len(words), dtype=np.int32), np.array([len(w) for w in words], np.int64))
    p, u = positive.nonzero()[0], (~positive).nonzero()[0]
    w = np.zeros(used + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    if len(p) and len(u):
        for step in range(1, STEPS + 1):
            z = np.bincount(row, w[flat], len(words)) + w[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss = np.logaddexp(0, z)
            negative = loss[u].mean() - prior * loss[p].mean()
            g = np.zeros(len(words))
            if negative >= 0:
                g[p] = prior * (s[p] - 1) / len(p) - prior * s[p] / len(p)
                g[u] = s[u] / len(u)
            else:
                g[p], g[u] = prior * s[p] / len(p), -s[u] / len(u)
            grad = np.append(np.bincount(flat, g[row], used), g.sum()) + DECAY * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float]:
    """Mean weights and bias of the BAGS classifiers, from rows that are not held out.

    The words are chosen by counts over all positives, copies of a text counting once, and over all documents. Samples are
    taken by a hash of id and text, so a rerun takes the same rows and rows of one id part; their expected sizes are POSITIVES
    and UNLABELLED, which bounds the tasks of the gradient steps. Labels of null ids or ids without a document teach nothing and null labels are
    passed over. Without positives every score is below 0.02, and without labels 0.5.
    """
    known = labels.filter(~C.held_out(F.col("doc_id")) & F.col(label).isNotNull())
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) == 1).cast("long")), F.lit(0))).first()
    size = 1 << WORD_BITS
    if not ones:
        return np.zeros(size), -4.0 if n else 0.0
    prior = min(ones / n, 0.95)
    # written, so that Spark knows its size before it joins: it is sent to the tasks if it is small, and else filters the texts before they move
    ids = C.written(known.filter(F.col(label) == 1).select("doc_id").distinct())
    plain = docs.select("doc_id", "text").filter(~C.held_out(F.col("doc_id")))
    toxic = C.written(plain.join(ids, "doc_id", "left_semi").withColumn("copy", F.xxhash64("text")))
    of_positives, positives = document_counts(toxic.dropDuplicates(["copy"]))
    of_all, rows = document_counts(plain)
    if not rows:
        return np.zeros(size), np.log(prior / (1 - prior))
    used = choose(of_positives, positives, of_all, rows)
    share = lambda most, count: F.pmod(F.xxhash64("doc_id", "text", F.lit(SALT)), F.lit(1 << 30)) < int(min(1.0, most / max(count, 1)) * (1 << 30))
    bag = F.pmod(F.xxhash64("doc_id", "text", F.lit(SALT + 1)), F.lit(BAGS)).cast("int").alias("bag")
    sampled = toxic.filter(share(POSITIVES, toxic.count())).select(F.explode(F.sequence(F.lit(0), F.lit(BAGS - 1))).alias("bag"), F.lit(True).alias("positive"), "text")
    unlabelled = plain.filter(share(UNLABELLED, rows)).select(bag, F.lit(False).alias("positive"), "text")
    featured = sampled.union(unlabelled).mapInArrow(_featured(used), "bag int, positive boolean, words array<int>")
    count = len(used)

    def one(bag: pd.DataFrame) -> pd.DataFrame:
        w, b = train([np.asarray(x, np.int32) for x in bag["words"]], bag["positive"].to_numpy(bool), count, prior)
        return pd.DataFrame({"w": [w], "b": [b]})

    weights, bias, bags = np.zeros(size), 0.0, 0
    for r in featured.groupBy("bag").applyInPandas(one, "w array<double>, b double").collect():  # BAGS rows of at most 2**WORD_BITS weights
        weights[used] += np.array(r["w"])
        bias, bags = bias + r["b"], bags + 1
    return (weights / bags, bias / bags) if bags else (weights, np.log(prior / (1 - prior)))


def scores(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every row from its whole text.

    Null and empty texts score alike, by the bias; rows that repeat score alike, whatever their ids;
    a very long text is one chunk; an empty table gives no rows; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(batches):
        w = sent.value
        for b in batches:
            for i, j, data, at in C.chunks(b.column("text")):
                words, ends = word_sets(data, at)
                sums = np.zeros(len(words) + 1)
                np.cumsum(w[words], out=sums[1:])
                z = sums[ends[1:]] - sums[ends[:-1]] + bias
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op5_toxicity_pu(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    scored = scores(docs, *fit(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
