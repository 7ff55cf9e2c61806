"""Histogram boosting against a plain-Python booster, Shapley values against all subsets, and what is built on them."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermalis.operators import boosting, model

SCHEMA = "id long, block long, label string, a double, b double, c double"


def table(spark, n=160, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randrange(3)
        rows.append((i, rng.randrange(12), ("coal", "gas", "oil")[y], y + rng.gauss(0, 0.4), float(rng.randrange(5)), None if rng.random() < 0.3 else y * 2.0 + rng.randrange(2)))
    return spark.createDataFrame(rows, SCHEMA)


def boosted(rows, labels, weight, classes, trees, group):
    """Out of the definition: exact splits over all values, row by row. rows: (number of the row, features with None for missing)."""
    margins, forest = [[0.0] * classes for _ in rows], []
    features = len(rows[0][1])
    for turn in range(trees):
        used = boosting.sampled(np.array([r for r, _ in rows]), turn)
        probs = []
        for m in margins:
            e = [math.exp(x - max(m)) for x in m]
            probs.append([x / sum(e) for x in e])
        grown = []
        for c in range(classes):
            g = [round((p[c] - (y == c)) * weight[y] * boosting.UNIT) / boosting.UNIT for p, y in zip(probs, labels, strict=True)]
            h = [round(2 * p[c] * (1 - p[c]) * weight[y] * boosting.UNIT) / boosting.UNIT for p, y in zip(probs, labels, strict=True)]
            allowed = np.flatnonzero(boosting.features_of(turn, group, c, features))

            def grow(own, depth, g=g, h=h, allowed=allowed):
                gs, hs = sum(g[i] for i in own), sum(h[i] for i in own)
                best = (boosting.GAIN, None)
                for f in allowed if depth < boosting.DEPTH else ():
                    values = sorted({rows[i][1][f] for i in range(len(rows))} - {None})
                    for missing_left in (False, True):
                        for v in values:
                            left = [i for i in own if (missing_left if rows[i][1][f] is None else rows[i][1][f] <= v)]
                            gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                            if hl >= boosting.CHILD and hs - hl >= boosting.CHILD:
                                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                                if gain > best[0]:
                                    best = (gain, (f, v, missing_left, left))
                if best[1] is None:
                    return -boosting.STEP * gs / (hs + 1)
                f, v, missing_left, left = best[1]
                return f, v, missing_left, grow(left, depth + 1), grow([i for i in own if i not in set(left)], depth + 1)

            grown.append(grow([i for i in range(len(rows)) if used[i]], 0))
        for m, (_, x) in zip(margins, rows, strict=True):
            for c in range(classes):
                m[c] += leaf(grown[c], x)
        forest.append(grown)
    return forest, margins


def leaf(tree, x):
    while isinstance(tree, tuple):
        f, v, missing_left, left, right = tree
        tree = left if (missing_left if x[f] is None else x[f] <= v) else right
    return tree


def test_agrees_with_a_plain_booster(spark):
    rows = table(spark, 90)
    state, classes, edges = model._prepared(rows.withColumn("fold", (F.col("block") % 2).cast("int")), ["a", "b", "c"], "label")
    kept = sorted(state.select("row", "fold", "labels", "_row").collect(), key=lambda r: r["row"])
    grown, ended = boosting.train(state.drop("_row"), [len(e) for e in edges], [(0, 0), (0, 1), (0, -1)], 3, 6)
    margins = {r["row"]: np.frombuffer(bytes(r["margins"])).reshape(3, 3) for r in ended.collect()}
    for group, without in enumerate((0, 1, -1)):
        own = [r for r in kept if r["fold"] != without]
        labels = [r["labels"][0] for r in own]
        weight = [len(own) / (3 * labels.count(c)) for c in range(3)]
        # cuts are over the values of all rows, as the bins are
        forest, want = boosted([(r["row"], [r["_row"][f] for f in "abc"]) for r in own], labels, weight, 3, 6, group)
        for r, m in zip(own, want, strict=True):
            assert margins[r["row"]][group] == pytest.approx(m, abs=1e-9)
        for r in kept:  # rows of the fold that is left out are judged by the same trees
            if r["fold"] == without:
                assert margins[r["row"]][group] == pytest.approx([sum(leaf(t[c], [r["_row"][f] for f in "abc"]) for t in forest) for c in range(3)], abs=1e-9)


def test_partitions_do_not_matter(spark, monkeypatch):
    rows = table(spark, 120, 4)
    one = {r["id"]: r["proba"] for r in model.cross_validated(rows, ["a", "b", "c"], "block", k=3, trees=6).collect()}
    monkeypatch.setattr(boosting, "WORK", 200)
    monkeypatch.setattr(boosting, "KEPT", 4)
    many = {r["id"]: r["proba"] for r in model.cross_validated(rows.repartition(7), ["a", "b", "c"], "block", k=3, trees=6).collect()}
    assert one == many


def test_signal_is_learnt_and_noise_is_not(spark):
    rows = table(spark, 240)
    out = model.cross_validated(rows, ["a", "b", "c"], "block", trees=15)
    got = out.collect()
    assert sum(r["predicted"] == r["label"] for r in got) > 0.85 * len(got)
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 and r["confidence"] == max(r["proba"]) for r in got)
    assert all(len({r["fold"] for r in got if r["block"] == b}) == 1 for b in range(12))
    noise = model.cross_validated(rows, ["b"], "block", trees=6).collect()
    assert sum(r["predicted"] == r["label"] for r in noise) < 0.5 * len(noise)


def test_model_is_kept_and_odd_rows_are_judged(spark, tmp_path):
    rows = table(spark)
    fitted = model.fit(rows, ["a", "b", "c"], trees=8)
    fitted.save(spark, str(tmp_path / "model"))
    again = boosting.Model.load(spark, str(tmp_path / "model"))
    odd = rows.unionByName(spark.createDataFrame([(900, None, None, None, float("nan"), None), (901, 1, "gas", 1e300, -1e300, 0.5)], SCHEMA)).withColumn("_f0", F.lit("clash"))
    one, two = (sorted(map(tuple, m.predict(odd).drop("proba").collect()), key=lambda r: r[0]) for m in (fitted, again))
    assert repr(one) == repr(two) and len(one) == 162 and {r[-2] for r in one} <= {"coal", "gas", "oil"}
    assert again.predict(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="label inputs"):
        model.fit(rows.withColumnRenamed("a", "latitude"), ["latitude", "b"])
    with pytest.raises(ValueError, match="class is missing"):
        model.cross_validated(rows.withColumn("label", F.when(F.col("block") == 3, "rare").otherwise(F.col("label"))), ["a"], "block", trees=1)


def subset_value(trees, t, c, x, known):
    """A tree's expected value when only the features in `known` are: other splits weigh their sides by cover."""

    def at(node):
        f = trees.feature[t, 0, c, node] if node < boosting.INNER else -1
        if f < 0:
            return trees.value[t, 0, c, node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            goes = not trees.left[t, 0, c, node] if x[f] == boosting.MISSING else x[f] > trees.cut[t, 0, c, node]
            return at(right if goes else left)
        cover = trees.cover[t, 0, c]
        return (cover[left] * at(left) + cover[right] * at(right)) / cover[node]

    return at(0)


def test_shapley_values_against_all_subsets(spark):
    rng = random.Random(3)
    names = [f"f{i}" for i in range(6)]
    data = [(i, ("x", "y", "z")[(i % 7 > 3) + (i % 11 > 6)], *[None if rng.random() < 0.1 else float((i * (k + 3)) % (7 + k) + rng.randrange(2)) for k in range(6)]) for i in range(200)]
    rows = spark.createDataFrame(data, "id long, label string, " + ", ".join(f"{n} double" for n in names))
    fitted = model.fit(rows, names, trees=5)
    some = rows.filter("id < 6")
    values = [np.array([np.nan if r[n] is None else r[n] for r in some.orderBy("id").collect()]) for n in names]
    bins = boosting.binned(values, fitted.edges)
    found = sorted(fitted.contributions(some).collect(), key=lambda r: r["id"])
    for i, r in enumerate(found):
        phi = np.array(r["contributions"]).reshape(3, 7)
        assert phi.sum(1) == pytest.approx(r["margins"], abs=1e-9)
        for c in range(3):
            v = {s: sum(subset_value(fitted.trees, t, c, bins[i], s) for t in range(5)) for n in range(7) for s in map(frozenset, itertools.combinations(range(6), n))}
            assert phi[c, 6] == pytest.approx(v[frozenset()], abs=1e-9)
            for j in range(6):
                want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (v[s | {j}] - v[s]) for s in v if j not in s)
                assert phi[c, j] == pytest.approx(want, abs=1e-9)
    of = {(r["class"], r["feature"]): r["importance"] for r in fitted.importance(rows).collect()}
    assert len(of) == 4 * 6 and of[None, "f0"] == pytest.approx(sum(of[c, "f0"] for c in "xyz") / 3)


def test_permutation_test(spark, monkeypatch):
    monkeypatch.setattr(model, "STRATUM", 60)
    got = model.permutation_test(table(spark, 150), ["a", "b", "c"], "block", k=3, trees=6, permutations=9).orderBy("permutation").collect()
    assert [r["permutation"] for r in got] == list(range(10)) and {r["p_value"] for r in got} == {0.1}
    assert got[0]["balanced_accuracy"] > 0.8 and max(r["balanced_accuracy"] for r in got[1:]) < 0.6
    direct = {r["class"]: r for r in model.scores(model.cross_validated(table(spark, 150), ["a", "b", "c"], "block", k=3, trees=6)).collect()}
    assert got[0]["balanced_accuracy"] == pytest.approx(direct["gas"]["balanced_accuracy"], abs=1e-6)


def test_shuffled_labels_keep_the_counts(spark):
    state, _, _ = model._prepared(table(spark, 130).withColumn("fold", F.lit(0)), ["a"], "label", 4)
    labels = np.array([r["labels"] for r in state.collect()])
    assert labels.shape == (130, 5) and all(sorted(labels[:, p]) == sorted(labels[:, 0]) for p in range(5))
    assert all((labels[:, p] != labels[:, 0]).any() for p in range(1, 5))


def test_scores(spark):
    rows = spark.createDataFrame([("x", "x"), ("y", "z"), ("z", "z"), ("z", "z"), (None, "x")], "label string, predicted string")
    got = {r["class"]: r for r in model.scores(rows).collect()}
    assert got["z"]["recall"] == 1.0 and got["z"]["precision"] == pytest.approx(2 / 3) and got["y"]["f1"] == 0.0 and got["x"]["support"] == 1
    assert got["x"]["accuracy"] == 0.75 and got["x"]["balanced_accuracy"] == pytest.approx(2 / 3) and got["x"]["macro_f1"] == pytest.approx((1 + 0 + 0.8) / 3)


def test_edges(spark):
    rows = spark.createDataFrame([(float(i % 3), float(i), None) for i in range(1000)], "few double, many double, none double")
    few, many, none = boosting.edges_of(rows, ["few", "many", "none"], 20)
    assert few.tolist() == [0.0, 1.0, 2.0] and len(many) == 20 and many[-1] == 999.0 and len(none) == 0
    assert boosting.binned([np.array([-1.0, 0.0, 0.5, 2.0, 9.0, np.nan])], [few])[:, 0].tolist() == [0, 0, 1, 2, 2, boosting.MISSING]


def test_trees_are_walked_by_whole_columns():
    """A round's trees over many rows: the walk of each row alone gives the same nodes and sums, in a small part of the time that gathers took."""
    rng = np.random.default_rng(5)
    at = (2, 5, 3)
    feature = rng.integers(-1, 2, (*at, boosting.INNER)).astype(np.int16)
    trees = boosting.Trees(feature, rng.integers(0, 255, feature.shape).astype(np.int16), rng.random(feature.shape) < 0.5, rng.random((*at, boosting.NODES)), rng.random((*at, boosting.NODES)))
    bins = rng.integers(0, 256, (500, 2)).astype(np.uint8)

    def walked(t, g, c, row):
        node = 0
        while node < boosting.INNER and (f := trees.feature[t, g, c, node]) >= 0:
            b = bins[row, f]
            node = 2 * node + 1 + int(not trees.left[t, g, c, node] if b == boosting.MISSING else b > trees.cut[t, g, c, node])
        return node

    want = np.array([[[[walked(t, g, c, row) for row in range(len(bins))] for c in range(3)] for g in range(5)] for t in range(2)])
    assert all((trees.nodes(t, bins) == want[t].reshape(15, -1)).all() for t in range(2))
    sums = sum(np.take_along_axis(trees.value[t], want[t], 2) for t in range(2))
    assert (trees.margins(bins) == sums.transpose(2, 0, 1)).all()
    many = np.tile(bins, (100, 1))
    start = time.process_time()
    for _ in range(5):
        trees.nodes(0, many)
    assert time.process_time() - start < 0.25  # 0.7 s by gathers


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_few_cells_are_grown_in_one_job(spark, monkeypatch):
    """Cells of equal rows: the jobs do not grow with the rounds, and trees, margins and predictions are those of the level by level way."""
    rows = table(spark, 700, 2).withColumn("a", F.round("a"))
    found = []
    for most in (boosting.CELLS, 0):
        monkeypatch.setattr(boosting, "CELLS", most)
        spent = []
        for trees in (2, 12):
            before = jobs(spark)
            out = model.cross_validated(rows, ["a", "b", "c"], "block", k=3, trees=trees).collect()
            spent.append(jobs(spark) - before)
        state, classes, edges = model._prepared(rows.withColumn("fold", (F.col("block") % 2).cast("int")), ["a", "b", "c"], "label")
        grown, ended = boosting.train(state.drop("_row"), [len(e) for e in edges], [(0, 0), (0, 1), (0, -1)], 3, 12)
        found.append((spent, {r["id"]: (r["fold"], r["predicted"], tuple(r["proba"])) for r in out}, {n: x.tolist() for n, x in vars(grown).items()}, {r["row"]: bytes(r["margins"]) for r in ended.collect()}))
    (few, *one), (many, *other) = found
    assert one == other and len(one[0]) == len(one[2]) == 700
    assert few[0] == few[1] and many[1] >= many[0] + 30  # 3 jobs a round before
