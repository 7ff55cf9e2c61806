"""Source classifier: boosted trees over all classes at once, validated on spatial blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from . import boosting
from .boosting import DEPTH, SEED, STEP, TREES, Model

__all__ = ["DEPTH", "FOLDS", "PERMUTATIONS", "SEED", "STEP", "TREES", "check_leakage", "confusion", "cross_validated", "fit", "folds", "permutation_test", "scores", "usable"]
FOLDS, PERMUTATIONS, STRATUM = 5, 100, 1000
#: Results that a predicting task keeps, about.
KNOWN = 1 << 16
#: Inputs of the labels may never be features.
BARRED = frozenset({"label", "label_group", "evidence", "distance_m", "groups_near", "latitude", "longitude", "x", "y", "cell"})


def check_leakage(names: list[str], barred: frozenset[str] = BARRED) -> None:
    if found := sorted(set(names) & barred):
        raise ValueError(f"features are label inputs: {found}")


def usable(rows: DataFrame, names: list[str]) -> list[str]:
    """Names of the columns that have two values at least."""
    n = rows.agg(*[F.countDistinct(c).alias(c) for c in names]).first()
    return [c for c in names if n[c] > 1]


def folds(rows: DataFrame, block: str, k: int = FOLDS) -> DataFrame:
    """rows with `fold`: a block is in one fold; blocks are dealt in order of size, largest first, back and forth."""
    sizes = rows.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_i", F.row_number().over(Window.orderBy(F.desc("_n"), block)) - 1)
    turn, place = F.floor(F.col("_i") / k) % 2, F.col("_i") % k
    return rows.join(sizes.select(block, F.when(turn == 0, place).otherwise(k - 1 - place).cast("int").alias("fold")), block)


def _prepared(rows: DataFrame, names: list[str], label: str, permutations: int = 0) -> tuple[DataFrame, list[str], list[np.ndarray]]:
    """State of training (row, fold, labels, bins, and the row itself), the classes in order, and the edges of the bins.

    Rows whose label is null take no part. Shuffled labels are permutations within strata of about STRATUM rows, dealt by
    a hash, so that no task holds all of them.
    """
    check_leakage(names)
    rows = rows.filter(F.col(label).isNotNull())
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # a handful, by the meaning of a class
    edges = boosting.edges_of(rows, names)
    number = F.element_at(F.create_map(*[F.lit(x) for pair in zip(classes, range(len(classes)), strict=True) for x in pair]), F.col(label))
    wide = rows.select(F.struct("*").alias("_row"), "fold", number.alias("label"), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(names)])
    keyed = wide.withColumn("row", F.xxhash64("_row"))

    def bins(batches):
        for b in batches:
            got = boosting.binned([boosting._floats(b.column(f"_f{i}")) for i in range(len(names))], edges)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "fold", "label", "_row")), pa.array([r.tobytes() for r in got], pa.binary())], ["row", "fold", "label", "_row", "bins"])

    whole = f"row long, fold int, label int, _row {wide.schema['_row'].dataType.simpleString()}, bins binary"
    state = keyed.mapInArrow(bins, whole)
    if not permutations:
        return state.select("row", "fold", F.array("label").alias("labels"), "bins", "_row"), classes, edges
    strata = max(1, rows.count() // STRATUM)

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        own = table.column("label").to_numpy()
        s = table.column("s")[0].as_py()
        labels = np.stack([own, *(np.random.default_rng([SEED, p, s]).permutation(own) for p in range(permutations))], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * labels.shape[1]), pa.array(labels.reshape(-1).astype(np.int32)))
        return pa.table([table.column("row"), table.column("fold"), lists, table.column("bins")], ["row", "fold", "labels", "bins"])

    dealt = state.drop("_row").withColumn("s", F.pmod(F.xxhash64("row"), F.lit(strata)))
    return dealt.groupBy("s").applyInArrow(shuffled, "row long, fold int, labels array<int>, bins binary"), classes, edges


def fit(rows: DataFrame, names: list[str], label: str = "label", trees: int = TREES) -> Model:
    """The model of all rows with a label. Missing values (null or NaN) go to the side that each split has learnt for them."""
    state, classes, edges = _prepared(rows.withColumn("fold", F.lit(0)), names, label)
    grown, _ = boosting.train(state.drop("_row"), [len(e) for e in edges], [(0, -1)], len(classes), trees)
    return Model(names, classes, edges, grown)


def cross_validated(rows: DataFrame, names: list[str], block: str, label: str = "label", k: int = FOLDS, trees: int = TREES) -> DataFrame:
    """rows with fold, predicted, confidence and proba (of each class, in order), each row by trees that saw none of its block.

    All folds are trained side by side. A class that the rest of a fold lacks is an error.
    """
    state, classes, edges = _prepared(folds(rows, block, k).withColumn("fold", F.col("fold").cast("int")), names, label)
    state = written(state)
    grown, _ = boosting.train(state.drop("_row"), [len(e) for e in edges], [(0, f) for f in range(k)], len(classes), trees)
    kinds, width = pa.array(classes), len(edges)

    def predicted(batches):
        known, kept = {}, np.zeros((0, len(kinds)))  # a task walks the trees once for each fold and bins
        for b in batches:
            if not b.num_rows:
                continue
            fold = b.column("fold").to_numpy()
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(fold), width)
            key = np.concatenate([fold.astype(np.int32)[:, None].view(np.uint8), bins], 1)
            first, of_row = boosting.distinct(key)
            if len(known) > KNOWN:
                known, kept = {}, kept[:0]
            seen = len(known)
            place = np.array([known.setdefault(key[i].tobytes(), len(known)) for i in first])
            new = first[place >= seen]
            p = np.zeros((len(new), len(kinds)))
            for f in np.unique(fold[new]):
                own = fold[new] == f
                p[own] = boosting.softmax(grown.of(int(f)).margins(bins[new[own]])[:, 0])
            kept = np.concatenate([kept, p])
            p = kept[place[of_row]]
            yield pa.RecordBatch.from_arrays([b.column("_row"), kinds.take(pa.array(p.argmax(1))), pa.array(p.max(1)), boosting._lists(p)], ["_row", "predicted", "confidence", "proba"])

    out = state.select("fold", "bins", "_row").mapInArrow(predicted, f"_row {state.schema['_row'].dataType.simpleString()}, predicted string, confidence double, proba array<double>")
    return out.select("_row.*", "predicted", "confidence", "proba")


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def scores(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(class, precision, recall, f1, support, accuracy, balanced_accuracy, macro_f1) of every class that is a label or a prediction.

    Shares without a denominator are 0; the balanced accuracy is over the classes that are labels. One aggregation of the rows.
    """
    n = confusion(rows.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()), label, predicted)
    each = n.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("right")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("right")))).alias("x")).select("x.*")
    of = each.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("right"), F.col("said")), share(F.col("right"), F.col("support"))
    of = of.select("class", "support", "right", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
    total = of.agg(F.sum("right").alias("_right"), F.sum("support").alias("_n"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    return of.crossJoin(F.broadcast(total)).select("class", "precision", "recall", "f1", "support", (F.col("_right") / F.col("_n")).alias("accuracy"), "balanced_accuracy", "macro_f1")


def permutation_test(rows: DataFrame, names: list[str], block: str, label: str = "label", k: int = FOLDS, trees: int = TREES, permutations: int = PERMUTATIONS) -> DataFrame:
    """(permutation, balanced_accuracy, p_value): 0 is the labels as they are, the others are shuffled; p_value is (1 + those not below) / (1 + permutations).

    All permutations, folds and classes are trained in the same passes.
    """
    state, classes, edges = _prepared(folds(rows, block, k).withColumn("fold", F.col("fold").cast("int")), names, label, permutations)
    groups = [(p, f) for p in range(permutations + 1) for f in range(k)]
    _, state = boosting.train(state, [len(e) for e in edges], groups, len(classes), trees)
    shape = (permutations + 1, k, len(classes))

    def judged(batches):
        for b in batches:
            if not b.num_rows:
                continue
            margins = np.frombuffer(b"".join(b.column("margins").to_pylist()), np.float64).reshape(-1, *shape)
            labels, fold = np.array(b.column("labels").to_pylist()), b.column("fold").to_numpy()
            best = margins[np.arange(len(fold)), :, fold].argmax(2)
            counts = [(p, c, int((labels[:, p] == c).sum()), int(((labels[:, p] == c) & (best[:, p] == c)).sum())) for p in range(shape[0]) for c in range(shape[2])]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*counts, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["permutation", "class", "n", "right"])

    counted = state.mapInArrow(judged, "permutation int, class int, n long, right long").groupBy("permutation", "class").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    recall = counted.groupBy("permutation").agg(F.round(F.avg(F.col("right") / F.col("n")), 6).alias("balanced_accuracy"))
    seen = recall.filter("permutation = 0").select(F.col("balanced_accuracy").alias("_seen"))
    not_below = recall.crossJoin(F.broadcast(seen)).agg(((1 + F.sum(((F.col("permutation") > 0) & (F.col("balanced_accuracy") >= F.col("_seen"))).cast("int"))) / (1 + permutations)).alias("p_value"))
    return recall.crossJoin(F.broadcast(not_below))

