"""Gradient boosting of decision trees by histograms, for many targets in one pass.

Features are binned once. A group is one training set: a fold's rest, all rows, or either with shuffled
labels; each has one tree a class and round. Rows of equal fold, labels and bins are a cell: they have one
gradient, and rounds differ only in how many of them are sampled. Where the cells are few, whatever the number of rows, tasks count
each cell's rows of each round, and one job grows all rounds, a task a group. Where they are
many, a level of all trees of a round is one job: every task sums gradients of its rows by (group, class, node,
feature, bin), the sums of a group meet in one task, which chooses its splits, and the driver gets the splits alone. Gradients are
summed as integers, so that results depend neither on how rows lie in partitions nor on which of the two ways is taken.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: Fixed settings: rounds, depth, step, share of rows and of features of a tree, least hessian of a child, penalty, seed.
TREES, DEPTH, STEP, SUBSAMPLE, COLUMNS, CHILD, PENALTY, SEED = 300, 3, 0.05, 0.8, 0.8, 2.0, 1.0, 26162
#: Bins of a feature at most; the bin of missing values; units of a gradient; rounds between two written states; rows x trees of a task, about.
BINS, MISSING, UNIT, KEPT, WORK = 255, 255, 1 << 24, 10, 400_000
#: Where trees are grown from cells: cells x rounds at most in a group, and in all groups; rows x rounds that a task counts, about.
CELLS, CELLS_SENT, COUNTED = 1 << 24, 1 << 28, 1 << 25
INNER, NODES = (1 << DEPTH) - 1, (1 << DEPTH + 1) - 1
GAIN = 1e-6


def edges_of(rows: DataFrame, names: list[str], most: int = BINS) -> list[np.ndarray]:
    """Upper ends of each feature's bins: all its values if there are at most `most`, else that many quantiles. Two passes for all features."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    wide = rows.select(*[v.alias(c) for c, v in value.items()])
    shares = [float(q) for q in np.arange(1, most) / most]
    found = wide.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names], *[F.approx_count_distinct(c, 0.02).alias(f"_n{i}") for i, c in enumerate(names)], *[F.max(c).alias(f"_m{i}") for i, c in enumerate(names)]).first()
    few = [c for i, c in enumerate(names) if found[f"_n{i}"] <= most * 1.2]
    exact = {}
    if few:
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])).alias("x")).select("x.c", "x.v").filter("v IS NOT NULL").distinct()
        counted = long.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("c")
        for r in long.join(F.broadcast(counted), "c").collect():  # at most `most` values a feature
            exact.setdefault(r["c"], []).append(r["v"])
    out = []
    for i, c in enumerate(names):
        cuts = exact.get(c) or [*(found[c] or []), *([found[f"_m{i}"]] if found[f"_m{i}"] is not None else [])]
        out.append(np.unique(np.array(cuts, np.float64)))
    return out


def binned(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Rows x features of bins: the number of edges below the value; NaN is MISSING."""
    out = np.empty((len(values[0]) if values else 0, len(edges)), np.uint8)
    for j, (v, e) in enumerate(zip(values, edges, strict=True)):
        out[:, j] = np.where(np.isnan(v), MISSING, np.minimum(np.searchsorted(e, v), max(len(e) - 1, 0)))
    return out


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of bytes: the first place of each different row, and each row's number among these."""
    _, first, own = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return first, own


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(row: np.ndarray, turn: int, share: float = SUBSAMPLE, seed: int = SEED) -> np.ndarray:
    """Which rows the trees of a round see: a hash of the row's number and the round."""
    salt = mixed(np.array([seed * 1_000_003 + turn], np.uint64))
    return mixed(row.astype(np.uint64) ^ salt) < np.uint64(int(share * 2**64) if share < 1 else 2**64 - 1)


def features_of(turn: int, group: int, label: int, count: int, share: float = COLUMNS, seed: int = SEED) -> np.ndarray:
    """Whether a tree may split by each feature."""
    out = np.zeros(count, bool)
    out[np.random.default_rng([seed, turn, group, label]).permutation(count)[: max(1, round(share * count))]] = True
    return out


@dataclass
class Trees:
    """Trees of some rounds: arrays over (round, group, class, node). Children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, groups: int, classes: int, rounds: int = 0) -> Trees:
        at = (rounds, groups, classes)
        return cls(np.full((*at, INNER), -1, np.int16), np.zeros((*at, INNER), np.int16), np.zeros((*at, INNER), bool), np.zeros((*at, NODES)), np.zeros((*at, NODES)))

    def then(self, other: Trees) -> Trees:
        return Trees(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("feature", "cut", "left", "value", "cover")))

    def rounds(self, start: int, end: int) -> Trees:
        return Trees(*(getattr(self, n)[start:end] for n in ("feature", "cut", "left", "value", "cover")))

    def of(self, group: int) -> Trees:
        return Trees(*(getattr(self, n)[:, group : group + 1] for n in ("feature", "cut", "left", "value", "cover")))

    def nodes(self, turn: int, bins: np.ndarray) -> np.ndarray:
        """(groups x classes, rows): the node that each row comes to in a round's trees. Every split is one comparison of bytes over all rows."""
        feature, cut, left = (getattr(self, n)[turn].reshape(-1, INNER) for n in ("feature", "cut", "left"))
        node = np.zeros((len(feature), len(bins)), np.uint8)
        by_feature = np.ascontiguousarray(bins.T)
        known = by_feature != MISSING if left.any() else by_feature
        for own, *tree in zip(node, feature.tolist(), cut.tolist(), left.tolist(), strict=True):
            for k, (f, c, missing_left) in enumerate(zip(*tree, strict=True)):
                if f >= 0:
                    right = by_feature[f] > c  # MISSING is above all cuts
                    if missing_left:
                        right &= known[f]
                    own += (own == k) * (k + 1 + right.view(np.uint8))
        return node.astype(np.int64)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """(rows, groups, classes): the sums of all rounds' trees. Many rounds walk rows of equal bins once."""
        rounds, groups, classes, _ = self.value.shape
        if rounds > KEPT and bins.size:
            first, own = distinct(bins)
            if len(first) * 2 < len(bins):
                return self.margins(bins[first])[own]
        out = np.zeros((groups * classes, len(bins)))
        for t in range(rounds):
            for sums, value, node in zip(out, self.value[t].reshape(-1, NODES), self.nodes(t, bins), strict=True):
                sums += value.take(node)
        return np.ascontiguousarray(out.T).reshape(len(bins), groups, classes)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def best_splits(hist: np.ndarray, allowed: np.ndarray, sizes: list[int]) -> list[tuple]:
    """Of one tree's level: (feature or -1, cut, missing left, gradient and hessian of left, right) of each node.

    hist: (node, feature, bin, 2) in UNITs, the last bin holding missing values. The first of equal gains wins, in
    the order of features, bins, and missing values right before left.
    """
    total = hist[:, :1].sum(2)[:, 0].astype(np.float64) / UNIT
    out = []
    for node in range(len(hist)):
        g, h = total[node]
        best, found = GAIN, (-1, 0, False, 0.0, 0.0, 0.0, 0.0)
        for f in np.flatnonzero(allowed):
            n = sizes[f]
            run = np.cumsum(hist[node, f, :n], 0)
            gone = hist[node, f, -1]
            for left in (False, True):
                gl, hl = ((run + gone * left).astype(np.float64) / UNIT).T
                gr, hr = g - gl, h - hl
                gain = np.where((hl >= CHILD) & (hr >= CHILD), gl * gl / (hl + PENALTY) + gr * gr / (hr + PENALTY) - g * g / (h + PENALTY), 0.0)
                k = int(gain.argmax()) if n else 0
                if n and gain[k] > best:
                    best, found = float(gain[k]), (int(f), k, left, float(gl[k]), float(hl[k]), float(gr[k]), float(hr[k]))
        out.append((*found, float(g), float(h)))
    return out


SPLITS = "grp int, cls int, node int, feature int, cut int, lft boolean, gl double, hl double, gr double, hr double, g double, h double"


@dataclass
class Model:
    """Trees of all rows, their classes and features, and the edges of the bins."""

    names: list[str]
    classes: list[str]
    edges: list[np.ndarray] = field(repr=False)
    trees: Trees = field(repr=False)

    def _values(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.struct("*").alias("_row"), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(self.names)])

    def _apply(self, rows: DataFrame, shape: str, of_bins) -> DataFrame:
        """rows with further columns, which of_bins makes from a batch's bins."""
        n = len(self.names)

        def batches(parts):
            for b in parts:
                extra = of_bins(binned([_floats(b.column(i + 1)) for i in range(n)], self.edges))
                whole = b.column(0)
                yield pa.RecordBatch.from_arrays([whole, *extra.values()], ["_row", *extra])

        found = self._values(rows).mapInArrow(batches, f"_row {rows.schema.simpleString()}, {shape}")
        return found.select("_row.*", *[c for c in found.columns if c != "_row"])

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted (the class), confidence and proba (of each class, in order). No shuffle."""
        names = pa.array(self.classes)

        def of_bins(bins):
            p = softmax(self.trees.margins(bins)[:, 0])
            best = p.argmax(1)
            return {"predicted": names.take(pa.array(best)), "confidence": pa.array(p.max(1) if len(p) else np.empty(0)), "proba": _lists(p)}

        return self._apply(rows, "predicted string, confidence double, proba array<double>", of_bins)

    def contributions(self, rows: DataFrame) -> DataFrame:
        """rows with contributions (exact Shapley values, features within classes, the class's mean last) and margins; they sum to the margins."""

        def of_bins(bins):
            phi = shapley(self.trees, bins, len(self.names))
            return {"contributions": _lists(phi.reshape(len(bins), -1)), "margins": _lists(self.trees.margins(bins)[:, 0])}

        return self._apply(rows, "contributions array<double>, margins array<double>", of_bins)

    def importance(self, rows: DataFrame) -> DataFrame:
        """(class, feature, importance): the mean absolute contribution over rows; class null: over all classes."""
        n, c = len(self.names), len(self.classes)
        at = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in self.classes for _ in range(n + 1)]).alias("class"), F.array(*[F.lit(x) for _ in range(c) for x in [*self.names, None]]).alias("feature"), F.col("contributions").alias("v")))
        each = self.contributions(rows).select(at.alias("x")).select("x.class", "x.feature", F.abs("x.v").alias("v")).filter("feature IS NOT NULL")
        of_class = each.groupBy("class", "feature").agg(F.avg("v").alias("importance"))
        return of_class.unionByName(of_class.groupBy("feature").agg(F.avg("importance").alias("importance")).withColumn("class", F.lit(None).cast("string")))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row: names, classes and edges as JSON, trees as bytes with their shapes."""
        head = {"names": self.names, "classes": self.classes, "edges": [e.tolist() for e in self.edges], "trees": {n: [str(a.dtype), list(a.shape)] for n, a in vars(self.trees).items()}}
        spark.createDataFrame([(json.dumps(head), *[bytearray(a.tobytes()) for a in vars(self.trees).values()])], "head string, feature binary, cut binary, left binary, value binary, cover binary").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(path).first()
        head = json.loads(r["head"])
        arrays = {n: np.frombuffer(bytes(r[n]), kind).reshape(shape) for n, (kind, shape) in head["trees"].items()}
        return cls(head["names"], head["classes"], [np.array(e) for e in head["edges"]], Trees(**arrays))


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64) if column.null_count == 0 else column.fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1)))


def shapley(trees: Trees, bins: np.ndarray, count: int) -> np.ndarray:
    """(rows, classes, features + 1): path-dependent Shapley values of the margins; the last is the mean.

    A leaf adds its value if a row passes each of its path's features, and, for a feature that is
    not known, the share of the cover that passes. Features off the path add nothing, so the sum
    over subsets is one over the path's features, DEPTH at most.
    """
    rounds, _, classes, _ = trees.value.shape
    out = np.zeros((classes, count + 1, len(bins)))
    for t in range(rounds):
        for c in range(classes):
            feature, cut, left, value, cover = (getattr(trees, n)[t, 0, c] for n in ("feature", "cut", "left", "value", "cover"))
            stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
            while stack:
                node, path = stack.pop()
                if node < INNER and feature[node] >= 0:
                    f = int(feature[node])
                    b = bins[:, f]
                    right = np.where(b == MISSING, ~left[node], b > cut[node])
                    for child, passes in ((2 * node + 1, ~right), (2 * node + 2, right)):
                        share = cover[child] / cover[node]
                        before = path.get(f)
                        own = (passes, share) if before is None else (before[0] & passes, before[1] * share)
                        stack.append((child, path | {f: own}))
                    continue
                names, m = list(path), len(path)
                weight = value[node] * np.prod([z for _, z in path.values()])
                out[c, count] += weight
                for j in names:
                    rest = [path[k] for k in names if k != j]
                    phi = np.zeros(len(bins))
                    for subset in range(1 << m - 1):
                        size = subset.bit_count()
                        term = np.full(len(bins), value[node] * _ORDERS[m][size])
                        for k, (passes, share) in enumerate(rest):
                            term = term * (passes if subset >> k & 1 else share)
                        phi += term
                    out[c, j] += phi * (path[j][0] - path[j][1])
    return out.transpose(2, 0, 1)


_FACTORIAL = [1, 1, 2, 6, 24, 120, 720]
#: |S|! (m - |S| - 1)! / m! by m and |S|.
_ORDERS = {m: [_FACTORIAL[s] * _FACTORIAL[m - s - 1] / _FACTORIAL[m] for s in range(m)] for m in range(1, 7)}


def gradients(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian in UNITs. margins: (rows, groups, classes); labels: (rows, groups); weights: (groups, classes)."""
    p = softmax(margins)
    truth = labels[:, :, None] == np.arange(p.shape[2])
    w = np.take_along_axis(np.broadcast_to(weights, p.shape[:1] + weights.shape), labels[:, :, None], 2)
    return np.rint((p - truth) * w * UNIT).astype(np.int64), np.rint(np.maximum(2 * p * (1 - p) * w, 1e-16) * UNIT).astype(np.int64)


@dataclass
class Places:
    """Where the bins of all features lie in one row of sums; each feature has a further place for missing values."""

    sizes: list[int]

    def __post_init__(self) -> None:
        self.offsets = np.concatenate([[0], np.cumsum(np.array(self.sizes) + 1)])
        self.cells = int(self.offsets[-1])

    def of(self, bins: np.ndarray) -> np.ndarray:
        return self.offsets[:-1] + np.where(bins == MISSING, np.array(self.sizes), bins)

    def sums(self, node: np.ndarray, place: np.ndarray, grad: np.ndarray, hess: np.ndarray, width: int) -> np.ndarray:
        """(node x place, 2) of one tree's rows. Exact while sums stay below 2**53."""
        at = (node[:, None] * self.cells + place).reshape(-1)
        return np.stack([np.bincount(at, np.repeat(x, place.shape[1]), width * self.cells).astype(np.int64) for x in (grad, hess)], 1)

    def full(self, hist: np.ndarray) -> np.ndarray:
        """(node, feature, bin, 2) of (node, place, 2), as best_splits takes it."""
        out = np.zeros((len(hist), len(self.sizes), max(self.sizes) + 1, 2), np.int64)
        for f, n_bins in enumerate(self.sizes):
            out[:, f, :n_bins] = hist[:, self.offsets[f] : self.offsets[f] + n_bins]
            out[:, f, -1] += hist[:, self.offsets[f] + n_bins]
        return out


def split(now: Trees, at: tuple[int, ...], node: int, feature: int, cut: int, left: bool, gl: float, hl: float, gr: float, hr: float, g: float, h: float) -> None:
    """Enters a node's choice into a tree."""
    now.value[at][node], now.cover[at][node] = -STEP * g / (h + PENALTY), h
    if feature >= 0:
        now.feature[at][node], now.cut[at][node], now.left[at][node] = feature, cut, left
        for child, gc, hc in ((2 * node + 1, gl, hl), (2 * node + 2, gr, hr)):
            now.value[at][child], now.cover[at][child] = -STEP * gc / (hc + PENALTY), hc


def _bytes(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of a column of equally long byte strings, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _labels(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy().reshape(len(column), -1).astype(np.int64)


def used_rows(state: DataFrame, rows: int, trees: int) -> DataFrame:
    """(fold, labels, bins, used): of each cell, the number of its rows that the trees of each round see. A cell's rows meet in one task, which keeps counts alone."""

    def counts(batches):
        known, kept, used = {}, [], np.zeros((0, trees), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate([b.column("fold").to_numpy().astype(np.int32)[:, None].view(np.uint8), _labels(b.column("labels")).astype(np.int32).view(np.uint8), _bytes(b.column("bins"), np.uint8)], 1)
            first, own = distinct(key)
            seen, row = len(known), b.column("row").to_numpy()
            place = np.array([known.setdefault(key[i].tobytes(), len(known)) for i in first])
            kept.append(b.select(["fold", "labels", "bins"]).take(pa.array(first[place >= seen])))
            if len(known) > len(used):
                used = np.concatenate([used, np.zeros((max(len(known), 2 * len(used)) - len(used), trees), np.int32)])
            used[place] += np.stack([np.bincount(own[sampled(row, turn)], minlength=len(first)) for turn in range(trees)], 1).astype(np.int32)
        done = 0
        for b in kept:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([u.tobytes() for u in used[done : done + b.num_rows]], pa.binary())], ["fold", "labels", "bins", "used"])
            done += b.num_rows

    parts = max(1, -(-rows * trees // COUNTED))
    return state.select("row", "fold", "labels", "bins").repartition(parts, "fold", "labels", "bins").mapInArrow(counts, "fold int, labels array<int>, bins binary, used binary")


GROWN = "grp int, feature binary, cut binary, lft binary, value binary, cover binary"


def grown_from_cells(used: DataFrame, sizes: list[int], groups: list[tuple[int, int]], weights: np.ndarray, trees: int) -> Trees:
    """The trees of all groups, each group's rounds in one task over its cells."""
    classes, features, places = weights.shape[1], len(sizes), Places(sizes)

    def grow(table: pa.Table) -> pa.Table:
        g = table.column("grp")[0].as_py()
        bins = _bytes(table.column("bins"), np.uint8)
        first, of_row = distinct(bins)
        known, label = bins[first], _labels(table.column("labels"))[:, groups[g][0]]
        pairs, own = np.unique(of_row * classes + label, return_inverse=True)
        times = np.zeros((len(pairs), trees), np.int64)
        np.add.at(times, own, _bytes(table.column("used"), np.int32))
        times, profile, label = np.ascontiguousarray(times.T), pairs // classes, pairs % classes
        place, margins = places.of(known)[profile], np.zeros((len(known), 1, classes))
        done, recent = Trees.empty(1, classes), Trees.empty(1, classes)
        for turn in range(trees):
            now = Trees.empty(1, classes, 1)
            # sums of rounds are taken KEPT by KEPT, as the other way takes them
            grad, hess = gradients((margins + recent.margins(known))[profile], label[:, None], weights[g : g + 1])
            grad, hess = (x[:, 0] * times[turn][:, None] for x in (grad, hess))
            for depth in range(DEPTH):
                first, width = (1 << depth) - 1, 1 << depth
                nodes = now.nodes(0, known)[:, profile] - first
                for c in range(classes):
                    at = np.flatnonzero((nodes[c] >= 0) & (times[turn] > 0))
                    hist = places.sums(nodes[c, at], place[at], grad[at, c], hess[at, c], width).reshape(width, -1, 2)
                    for k, found in enumerate(best_splits(places.full(hist), features_of(turn, g, c, features), sizes)):
                        split(now, (0, 0, c), first + k, *found)
            recent = recent.then(now)
            if len(recent.value) == KEPT:
                margins, done, recent = margins + recent.margins(known), done.then(recent), Trees.empty(1, classes)
        whole = vars(done.then(recent))
        return pa.table([pa.array([g], pa.int32()), *[pa.array([whole[n].tobytes()], pa.binary()) for n in whole]], [x.split()[0] for x in GROWN.split(", ")])

    ways = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(without).alias("without")) for g, (_, without) in enumerate(groups)])
    sent = used.withColumn("w", F.explode(ways)).filter("w.without != fold").select("w.grp", "labels", "bins", "used")
    out = Trees.empty(len(groups), classes, trees)
    for r in sent.repartition(2 * len(groups), "grp").groupBy("grp").applyInArrow(grow, GROWN).toArrow().to_pylist():
        for name, blob in zip(vars(out), list(r.values())[1:], strict=True):
            whole = getattr(out, name)
            whole[:, r["grp"]] = np.frombuffer(blob, whole.dtype).reshape(whole[:, 0].shape)
    return out


def train(state: DataFrame, sizes: list[int], groups: list[tuple[int, int]], classes: int, trees: int = TREES) -> tuple[Trees, DataFrame]:
    """Trees of all groups, and the state with the margins of all rows.

    state: row (long), fold (int), labels (array<int>: the label's number, then the shuffled ones), bins
    (binary). groups: (which of the labels, the fold that is left out, or -1). sizes: bins of each feature.
    """
    n_groups, features = len(groups), len(sizes)
    which, without = np.array([g[0] for g in groups]), np.array([g[1] for g in groups])
    cells = state.groupBy("fold", "labels", "bins").agg(F.count(F.lit(1)).alias("n"))
    counted = cells.select("fold", "n", F.posexplode("labels").alias("which", "label")).groupBy("fold", "which", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect()
    n, n_cells = (sum(r[c] for r in counted if r["which"] == 0) for c in ("n", "cells"))
    parts = max(1, -(-n * n_groups * classes // WORK))
    per = np.zeros((n_groups, classes))
    for r in counted:
        per[(which == r["which"]) & (without != r["fold"]), r["label"]] += r["n"]
    if (per == 0).any():
        raise ValueError("a class is missing from the other folds")
    weights = per.sum(1, keepdims=True) / (classes * per)
    done, recent = Trees.empty(n_groups, classes), Trees.empty(n_groups, classes)
    places = Places(sizes)

    def read(b: pa.RecordBatch, since: Trees) -> tuple[np.ndarray, ...]:
        rows, bins = b.num_rows, _bytes(b.column("bins"), np.uint8)
        margins = np.zeros((rows, n_groups, classes))
        if b.column("margins").null_count == 0:
            margins = _bytes(b.column("margins"), np.float64).reshape(margins.shape).copy()
        if len(since.value) <= KEPT:
            margins += since.margins(bins) if len(since.value) else 0.0
        else:
            first, own = distinct(bins)
            for t in range(0, len(since.value), KEPT):
                margins += since.rounds(t, t + KEPT).margins(bins[first])[own]
        return bins, margins, _labels(b.column("labels")), b.column("fold").to_numpy(), b.column("row").to_numpy()

    def level(turn: int, since: Trees, now: Trees, depth: int) -> DataFrame:
        first, width = (1 << depth) - 1, 1 << depth

        def sums(batches):
            hist = np.zeros((n_groups, classes, width * places.cells, 2), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                bins, margins, labels, fold, row = read(b, since)
                grad, hess = gradients(margins, labels[:, which], weights)
                node = now.nodes(0, bins).reshape(n_groups, classes, -1) - first
                use = sampled(row, turn)[:, None] & (fold[:, None] != without)
                place = places.of(bins)
                for g in range(n_groups):
                    for c in range(classes):
                        own = np.flatnonzero(use[:, g] & (node[g, c] >= 0))
                        hist[g, c] += places.sums(node[g, c, own], place[own], grad[own, g, c], hess[own, g, c], width)
            blobs = [hist[g].tobytes() for g in range(n_groups)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_groups), pa.int32()), pa.array(blobs, pa.binary())], ["grp", "hist"])

        def choose(table: pa.Table) -> pa.Table:
            g = table.column("grp")[0].as_py()
            hist = np.zeros((classes, width, places.cells, 2), np.int64)
            for blob in table.column("hist"):
                hist += np.frombuffer(blob.as_buffer(), np.int64).reshape(hist.shape)
            rows = [(g, c, first + k, *found) for c in range(classes) for k, found in enumerate(best_splits(places.full(hist[c]), features_of(turn, g, c, features), sizes))]
            names = [x.split()[0] for x in SPLITS.split(", ")]
            types = [pa.int32()] * 5 + [pa.bool_()] + [pa.float64()] * 6
            return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        return state.mapInArrow(sums, "grp int, hist binary").groupBy("grp").applyInArrow(choose, SPLITS)

    def carried(since: Trees) -> DataFrame:
        def batches(parts_):
            for b in parts_:
                if b.num_rows:
                    margins = read(b, since)[1].reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "fold", "labels", "bins")), pa.array([m.tobytes() for m in margins], pa.binary())], ["row", "fold", "labels", "bins", "margins"])

        return state.mapInArrow(batches, "row long, fold int, labels array<int>, bins binary, margins binary")

    state = state.withColumn("margins", F.lit(None).cast("binary"))
    if n_cells * trees <= CELLS and n_cells * trees * n_groups <= CELLS_SENT and n * weights.max() < 1 << 28:
        done = grown_from_cells(used_rows(state, n, trees), sizes, groups, weights, trees)
        return done, carried(done)
    state = written(state.repartition(parts, "row"))
    for turn in range(trees):
        now = Trees.empty(n_groups, classes, 1)
        for depth in range(DEPTH):
            for r in level(turn, recent, now, depth).toArrow().to_pylist():
                grp, cls, node, *found = r.values()
                split(now, (0, grp, cls), node, *found)
        recent = recent.then(now)
        if len(recent.value) == KEPT or turn == trees - 1:
            state = written(carried(recent))
            done, recent = done.then(recent), Trees.empty(n_groups, classes)
    return done, state
