"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated.

The random cosines approximate a Gaussian kernel over the standardised statistics. Each partition
sums its own normal equations, Spark adds them, and the driver solves one small system (its size
is fixed by FEATURES, not by the data). Out-of-fold scores are binned and made into probabilities
by pooling adjacent violators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Cosine features, kernel width in standard deviations, ridge, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 2.0, 1e-3, 2000
#: Groups in which partitions' sums are added before the driver adds the rest.
GROUPS = 8
STATS = (
    "log_bytes", "log_words", "word_len", "word_len_sd", "upper", "digit", "space", "newline", "non_ascii", "bang", "pipe", "symbol",
    "stop", "comma", "upper_accent", "same_next", "distinct_words", "log_distinct", "short_words", "long_words", "symbol_ends", "line_words", "entropy", "distinct_lines",
)
SYMBOLS = b"#$%&*+/<=>@\\^_`{}~"


def _flag(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


UPPER, DIGIT, SYMBOL = _flag(range(65, 91)), _flag(range(48, 58)), _flag(SYMBOLS)
CLASSES = (UPPER, DIGIT, C.SPACE, _flag([10]), _flag(range(128, 256)), _flag(b"!"), _flag(b"|"), SYMBOL, _flag(b"."), _flag(b","))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATS for each text; an empty text has zeros."""
    n, docs = np.diff(at), len(at) - 1
    some = np.maximum(n, 1)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    out = {"log_bytes": np.log1p(n)}
    counts = [per_doc(c[data]) for c in CLASSES]
    for name, k in zip(("upper", "digit", "space", "newline", "non_ascii", "bang", "pipe", "symbol", "stop", "comma"), counts, strict=True):
        out[name] = k / some
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    out["upper_accent"] = per_doc(accent) / some
    starts, ends, first = C.word_bounds(~C.SPACE[data], at)
    words, length = np.diff(first), ends - starts
    many = np.maximum(words, 1)
    doc = np.repeat(np.arange(docs), words)
    out["log_words"], out["word_len"] = np.log1p(words), np.bincount(doc, length, docs) / many
    out["word_len_sd"] = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, docs) / many - out["word_len"] ** 2, 0))
    out["short_words"], out["long_words"] = np.bincount(doc[length <= 2], minlength=docs) / many, np.bincount(doc[length >= 14], minlength=docs) / many
    out["symbol_ends"] = np.bincount(doc[SYMBOL[data[ends - 1]]], minlength=docs) / many
    rolling = C.Rolling(C.BYTE_SYMBOLS[data])
    hashes = rolling.slices(starts, ends)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    out["same_next"] = np.bincount(doc[same], minlength=docs) / many

    def distinct(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        key = np.sort((hashes & np.uint64((1 << 40) - 1)) | (doc.astype(np.uint64) << np.uint64(40)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=docs)

    kinds = distinct(hashes, doc)
    out["distinct_words"], out["log_distinct"] = kinds / many, np.log1p(kinds)
    l_starts, l_ends, l_first = C.word_bounds(data != 10, at)
    lines = np.diff(l_first)
    out["line_words"] = np.log1p(words / np.maximum(lines, 1))
    out["distinct_lines"] = distinct(rolling.slices(l_starts, l_ends), np.repeat(np.arange(docs), lines)) / np.maximum(lines, 1)
    share = np.bincount(np.repeat(np.arange(docs), n) * 256 + data, minlength=docs * 256).reshape(docs, 256) / some[:, None]
    out["entropy"] = -np.where(share > 0, share * np.log2(np.maximum(share, 1e-12)), 0).sum(1)
    return np.stack([out[k] for k in STATS], 1).astype(np.float32)


def batch_statistics(column: pa.Array) -> np.ndarray:
    parts = [statistics(data, at) for _, _, data, at in C.chunks(column)]
    return np.concatenate(parts) if parts else np.empty((0, len(STATS)), np.float32)


def _stats_batches(batches):
    for b in batches:
        s = batch_statistics(b.column("text"))
        values = pa.ListArray.from_arrays(np.arange(0, s.size + 1, len(STATS), dtype=np.int32), pa.array(s.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), values], ["doc_id", "stats"])


@dataclass
class Model:
    """score(stats): probability of label 1."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.sd, -6, 6)
        rng = np.random.default_rng(17)
        turn, phase = rng.normal(0, 1 / (WIDTH * np.sqrt(x.shape[1] / 2)), (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        return np.concatenate([np.ones((len(x), 1)), x, np.cos(x @ turn + phase) * np.sqrt(2 / FEATURES) * 4], 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.knots, self.levels)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending x; (x, level) of the pools, with levels inside (0, 1)."""
    pools: list[list[float]] = []
    for xi, ni, oi in zip(x, n, ones, strict=True):
        pools.append([xi * ni, ni, oi])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])


def _summed(batches, width: int):
    """Add arrays that come as rows (group, fold, sums)."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for g, f, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[g, f] = total.get((g, f), 0) + np.frombuffer(s).reshape(-1)
    for (g, f), s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([f], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["group", "fold", "sums"])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the labelled rows of `stats` (doc_id, stats) that are not held out; null labels and ids are passed over.

    With no labelled row every score is 0.5; with labels of one kind, near that kind.
    """
    rows = stats.join(labels.select("doc_id", F.col(label).cast("double").alias("y")), "doc_id").filter(~C.held_out(F.col("doc_id")) & F.col("y").isNotNull()).select("stats", "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 % 2).cast("int").alias("fold"))
    rows = C.written(rows)
    d = len(STATS)
    m = rows.select(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    base = Model(np.zeros(d), np.ones(d), np.zeros(1 + d + FEATURES), np.zeros(1), np.full(1, 0.5))
    if not m["n"]:
        return base
    base.mean, base.sd = np.array([m[f"m{i}"] for i in range(d)]), np.maximum([m[f"s{i}"] for i in range(d)], 1e-3)
    k = 1 + d + FEATURES

    def sums(batches):
        total = np.zeros((2, k, k + 1))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold = base.features(b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for f in (0, 1):
                z = x[fold == f]
                total[f] += z.T @ np.c_[z, y[fold == f]]
        from pyspark import TaskContext

        g = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([g, g], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["group", "fold", "sums"])

    shape = "group int, fold int, sums binary"
    added = rows.mapInArrow(sums, shape).repartition(GROUPS, "group").mapInArrow(lambda bs: _summed(bs, k), shape)
    total = [np.zeros((k, k + 1)), np.zeros((k, k + 1))]
    for r in added.collect():  # at most 2 x GROUPS rows of fixed size
        total[r["fold"]] += np.frombuffer(r["sums"]).reshape(k, k + 1)

    def solve(t: np.ndarray) -> np.ndarray:
        return np.linalg.solve(t[:, :k] + RIDGE * max(t[0, 0], 1) * np.eye(k), t[:, k])

    halves, base.weights = np.stack([solve(total[1]), solve(total[0])], 1), solve(total[0] + total[1])

    def unseen(batches):
        for b in batches:
            x = base.features(b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float))
            raw = (x @ halves)[np.arange(len(x)), b.column("fold").to_numpy()]
            bin_ = np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(raw), b.column("y")], ["bin", "raw", "y"])

    bins = sorted(rows.mapInArrow(unseen, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect())  # at most BINS rows
    base.knots, base.levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("x", "n", "y")))
    return base


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, from whole texts; null text: as empty."""
    return docs.select("doc_id", "text").mapInArrow(_stats_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of statistics: equal texts score alike, whatever their ids; no rows, no scores."""

    def score(batches):
        for b in batches:
            s = model.score(b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS)).astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(score, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` (all columns) that score at least `threshold`.

    Every row is scored by its own text: repeated ids, nulls and extra columns do no harm. The
    texts are read twice, once for the statistics of the fit and once to filter.
    """
    model = fit(C.written(document_statistics(docs)), labels)

    def good(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(batch_statistics(b.column("text")).astype(float)) >= threshold))

    return docs.mapInArrow(good, docs.schema)


def op6_quality_classifier(spark, sf_dir):
    stats = C.written(document_statistics(C.table(spark, sf_dir, "documents")))
    scored = scores(stats, fit(stats, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
