"""Registry build: which cells burn year after year, and what each source is like."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

#: Fixed rules of the gate and of the clusters.
MONTHS, DAYS, YEARS, LINK_M, LEAST_WEIGHT, CAP_KM = 3, 10, 3, 500.0, 5, 20.0
ASSIGN_M = {"VIIRS": 500.0, "MODIS": 1000.0}
MONSOON, COVERAGE = (6, 7, 8, 9), 0.5
#: Pairs at most that one task matches in order; lines of a task that counts pairs, about; slices of labels at most.
SETTLED, COUNTED, SLICES = 4_000_000, 250_000, 32


def recurrence(det: DataFrame, key: str, at: str) -> DataFrame:
    """(key, year, days, months): distinct days and months of each year.

    A year is a calendar of bits, two months to a long, so that what a task keeps and what is shuffled is of one size a
    (key, year), however many days there are.
    """
    day = F.to_date(at)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((F.month(day) - 1) % 2 * 31 + F.dayofmonth(day) - 1).cast("int"))
    two = [F.coalesce(F.bit_or(F.when(F.floor((F.month(day) - 1) / 2) == i, bit)), F.lit(0).cast("long")).alias(f"_{i}") for i in range(6)]
    calendar = det.groupBy(key, F.year(day).alias("year")).agg(*two)
    low, pairs = F.lit((1 << 31) - 1), [F.col(f"_{i}") for i in range(6)]
    seen = [(half != 0).cast("long") for c in pairs for half in (c.bitwiseAND(low), F.shiftright(c, 31))]
    return calendar.select(key, "year", reduce(Column.__add__, [F.bit_count(c).cast("long") for c in pairs]).alias("days"), reduce(Column.__add__, seen).alias("months"))


def gated(recurring: DataFrame, key: str, months: int = MONTHS, days: int = DAYS, years: int = YEARS) -> DataFrame:
    """(key, years_passing) of the keys with enough years that have enough months and days."""
    ok = ((F.col("months") >= months) & (F.col("days") >= days)).cast("int")
    return recurring.groupBy(key).agg(F.sum(ok).alias("years_passing")).filter(F.col("years_passing") >= years)


def gate_sweep(recurring: DataFrame, key: str, gates: list[tuple[int, int, int]]) -> DataFrame:
    """(months, days, years, n_keys) for each gate, from one recurrence table: a key has one row, with its years in columns, whatever the gates."""
    years = {(m, d): f"_{m}_{d}" for m, d, _ in gates}
    per = recurring.groupBy(key).agg(*[F.sum(((F.col("months") >= m) & (F.col("days") >= d)).cast("int")).alias(c) for (m, d), c in years.items()])
    counts = per.agg(*[F.coalesce(F.sum((F.col(years[m, d]) >= y).cast("int")), F.lit(0)).alias(f"n{i}") for i, (m, d, y) in enumerate(gates)], F.count(F.lit(1)).alias("keys"))
    rows = F.array(*[F.struct(F.lit(m).alias("months"), F.lit(d).alias("days"), F.lit(y).alias("years"), F.col(f"n{i}").alias("n_keys")) for i, (m, d, y) in enumerate(gates)])
    return counts.filter("keys > 0").select(F.explode(rows).alias("g")).select("g.*")


def clusters(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of gated cells (id, x, y, weight), and per cluster n_cells, weight, width_km and capped."""
    label = spatial.weighted_dbscan(cells, LINK_M, LEAST_WEIGHT).filter("cluster is not null").select("id", "cluster")
    width = F.hypot(F.max("x") - F.min("x") + geo.CELL_M, F.max("y") - F.min("y") + geo.CELL_M) / 1000
    return label, cells.join(label, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("weight").alias("weight"), width.alias("width_km")).withColumn("capped", F.col("width_km") > CAP_KM)


def assign(det: DataFrame, cells: DataFrame) -> DataFrame:
    """det (detection_id, x, y, instrument) with the source of the nearest registered cell (cell, x, y, source) in its instrument's reach."""
    reach = F.when(F.col("instrument") == "VIIRS", ASSIGN_M["VIIRS"]).otherwise(ASSIGN_M["MODIS"])
    return spatial.nearest(det, cells, reach, max(ASSIGN_M.values()), "detection_id", "source", "cell")


def month_stats(days: DataFrame, key: str) -> DataFrame:
    """(key, month_entropy, peak_month_share, monsoon_share) over distinct days (key, day)."""
    n = days.select(key, "day").distinct().groupBy(key, F.month("day").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    p = n.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(key)))
    return p.groupBy(key).agg((F.sum(-F.col("p") * F.log("p")) / F.log(F.lit(12.0))).alias("month_entropy"), F.max("p").alias("peak_month_share"), F.sum(F.when(F.col("m").isin(*MONSOON), F.col("p")).otherwise(0.0)).alias("monsoon_share"))


def persistence(hits: DataFrame, clear: DataFrame, key: str, span: DataFrame | None = None) -> DataFrame:
    """(key, persistence): days with a detection over days on which one could be seen.

    hits: distinct (key, day); clear: (key, day, clear), the clear-sky fraction; span: (key, first,
    last), by default the hits' own; a (key, day) of clear is there once. A hit counts 1 above and below, another day its clear fraction
    below. Null when under half of the span's days have a fraction.
    """
    span = hits.groupBy(key).agg(F.min("day").alias("first"), F.max("day").alias("last")) if span is None else span
    # no table of days: a key's hit days go to it as an array, and the shares are summed where they are, without those of hit days
    own = hits.select(key, "day").distinct()
    within = F.col("day").between(F.col("first"), F.col("last"))
    of_key = span.select(key, "first", "last").join(own.groupBy(key).agg(F.collect_list("day").alias("hits")), key, "left")
    known = clear.filter(F.col("clear").isNotNull()).select(key, "day", "clear").join(of_key.hint("shuffle_hash"), key).filter(within)
    missed = ~F.coalesce(F.array_contains("hits", F.col("day")), F.lit(False))
    part = known.groupBy(key).agg(F.sum(F.when(missed, F.col("clear"))).alias("c"), F.count("clear").alias("n"))
    count = own.join(span.select(key, "first", "last"), key).filter(within).groupBy(key).agg(F.count(F.lit(1)).alias("h"))
    length = F.datediff("last", "first") + 1
    sums = span.join(part, key, "left").join(count, key, "left").select(key, F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("c", F.lit(0.0)).alias("c"), (F.coalesce("n", F.lit(0)) / length).alias("known"))
    return sums.select(key, F.when((F.col("known") >= COVERAGE) & (F.col("h") + F.col("c") > 0), F.col("h") / (F.col("h") + F.col("c"))).alias("persistence"))


def fingerprints(det: DataFrame, clusters_: DataFrame, clear: DataFrame | None = None) -> DataFrame:
    """One row of 27 features a source, and its first and last day.

    det: source, acq_datetime, daynight, frp, bt4, bt5, vnf_temp_k, vnf_area_m2; clusters_: source,
    n_cells, width_km; clear: source, daynight, day (date), clear. NaN counts as null.
    """
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = det.filter("source is not null").select("source", F.to_date("acq_datetime").alias("day"), (F.col("daynight") == "N").alias("night"), *[value(c).alias(c) for c in ("frp", "bt4", "bt5", "vnf_temp_k", "vnf_area_m2")])
    at = lambda night, c: F.median(F.when(F.col("night") == F.lit(night), c))
    span = F.datediff(F.max("day"), F.min("day")) + 1
    wide = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_det"), F.countDistinct(F.year("day")).alias("years_active"), (F.count(F.lit(1)) / F.greatest(span / 365.25, F.lit(1.0))).alias("det_per_year"), F.avg(F.col("night").cast("int")).alias("night_share"),
        F.median("frp").alias("frp_med"), F.percentile("frp", F.lit(0.9)).alias("frp_p90"), F.percentile("frp", F.lit(0.99)).alias("frp_p99"), at(True, F.col("frp")).alias("frp_night_med"), at(False, F.col("frp")).alias("frp_day_med"),
        at(True, F.col("bt4")).alias("bt4_night_med"), at(False, F.col("bt4")).alias("bt4_day_med"), at(True, F.col("bt5")).alias("bt5_night_med"), at(True, F.col("bt4") - F.col("bt5")).alias("bt45_night_med"), at(False, F.col("bt4") - F.col("bt5")).alias("bt45_day_med"),
        F.median("vnf_temp_k").alias("temp_med"), F.percentile("vnf_temp_k", F.lit(0.9)).alias("temp_p90"), F.avg(F.col("vnf_temp_k").isNotNull().cast("int")).alias("temp_cov"), F.median("vnf_area_m2").alias("area_med"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    mad = rows.join(wide.select("source", "frp_med"), "source").groupBy("source").agg(F.median(F.abs(F.col("frp") - F.col("frp_med"))).alias("frp_mad"))
    out = wide.join(mad, "source").join(clusters_.select("source", "n_cells", "width_km"), "source").join(month_stats(rows, "source"), "source")
    out = out.withColumn("frp_robust_cv", F.when(F.col("frp_med") != 0, F.col("frp_mad") / F.col("frp_med")))
    for name, letter in (("persistence_night", "N"), ("persistence_day", "D")):
        if clear is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        hits = rows.filter(F.col("night") == F.lit(letter == "N")).select("source", "day").distinct()
        own = wide.select("source", F.col("first_day").alias("first"), F.col("last_day").alias("last"))
        p = persistence(hits, clear.filter(F.col("daynight") == letter).select("source", "day", "clear"), "source", own)
        out = out.join(p.withColumnRenamed("persistence", name), "source", "left")
    return out


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the commonest value, the least on ties; null values do not count."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """(label, old_id, n): cells that a new cluster and an old source share. new: cell, label; old: cell, old_id; repeated rows count once.

    Each side is shuffled once, by cell, and so are the pairs, as they are: few pairs repeat within a task, and sums of them
    would hold nearly all of its pairs in memory. Pairs go to all shuffle partitions, since joined ones would be sums of more pairs.
    """
    of_cell = lambda side, c: side.select("cell", F.struct(c).alias("s")).filter("cell IS NOT NULL").repartition("cell").groupBy("cell").agg(F.collect_set("s").alias(c))
    sets = of_cell(new, "label").join(of_cell(old, "old_id").hint("merge"), "cell")
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = sets.select("old_id", F.explode("label").alias("s")).select("s.label", F.explode("old_id").alias("s")).select("label", "s.old_id").repartition(parts, "label", "old_id")
    return pairs.groupBy("label", "old_id").agg(F.count(F.lit(1)).alias("n"))


def match_ids(shared: DataFrame) -> DataFrame:
    """(label, old_id): greedy one-to-one by overlap, ties by label and id.

    Each round keeps the pairs that are best for both sides and drops the rest of their rows, which
    equals the greedy order; the number of rounds is that of the longest chain of contested pairs. The best of each side come
    from sums that are made before the shuffle, so no round sorts or moves the pairs that are left.
    """
    from ..tables import written

    found, left = None, written(shared.filter("label IS NOT NULL AND old_id IS NOT NULL"))
    rank = F.struct((-F.col("n")).alias("n"), "label", "old_id")
    while True:
        first = lambda k: left.groupBy(k).agg(F.min(rank).alias("m")).select("m.label", "m.old_id")
        best = written(first("label").join(first("old_id"), ["label", "old_id"]))
        if not best.limit(1).count():
            return found if found is not None else shared.select("label", "old_id")
        found = best if found is None else found.union(best)
        left = written(left.join(best.select("label"), "label", "left_anti").join(best.select("old_id"), "old_id", "left_anti"))


def _in_turn(pairs: pa.Table) -> pa.Table:
    """Pairs (label, old_id, n) that are taken one after the other, best first."""
    pairs = pairs.sort_by([("n", "descending"), ("label", "ascending"), ("old_id", "ascending")])
    taken: dict = {}
    used = set()
    for b in pairs.to_batches(1 << 16):
        for label, old in zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("label", "old_id")), strict=True):
            if old not in used and label not in taken:
                taken[label] = old
                used.add(old)
    kinds = pairs.schema.field("label").type, pairs.schema.field("old_id").type
    return pa.table([pa.array(list(taken), kinds[0]), pa.array(list(taken.values()), kinds[1])], ["label", "old_id"])


def match_overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """(label, old_id): match_ids(overlaps(new, old)), without a table of all pairs. Labels are numbers.

    Nearly all pairs share one cell only, and most of them can no longer be taken when their turn comes. So pairs of two
    cells and more are counted and matched first. Pairs of one cell are made afterwards, from the rows of labels and ids that are
    still free, for slices of labels in order, the next one twice as large; where no id is left, none is made. (Of a free label and a free id no
    pair of two cells is left, so these need no count.) What is left of a slice is matched in order in one task if it is small, else it is sliced again, by labels,
    or goes to match_ids.
    """
    from ..tables import written

    shape = f"label {new.schema['label'].dataType.simpleString()}, old_id {old.schema['old_id'].dataType.simpleString()}"
    new, old = (side.select("cell", c).filter(f"cell IS NOT NULL AND {c} IS NOT NULL") for side, c in ((new, "label"), (old, "old_id")))
    found: DataFrame | None = None

    def free(rows: DataFrame) -> DataFrame:
        for c in ("label", "old_id") if found is not None else ():
            rows = rows.join(found.select(c), c, "left_anti") if c in rows.columns else rows
        return rows

    def settle(pairs: DataFrame, one: bool) -> None:
        """Takes what pairs (one: of equal n) add to found."""
        nonlocal found
        left = written(free(pairs))
        n = left.count()
        if not n:
            return
        parts = min(-(-2 * n // SETTLED), SLICES)
        if one and n > SETTLED:
            for part in sliced(left, [i / parts for i in range(1, parts)]):
                settle(left.filter(part), False)
            return
        got = match_ids(left) if n > SETTLED else left.groupBy().applyInArrow(_in_turn, shape)
        found = written((got if found is None else found.union(got)).coalesce(1))

    def sliced(rows: DataFrame, shares: list[float]) -> list[Column]:
        cuts = sorted(set(rows.agg(F.percentile_approx("label", shares).alias("c")).first()["c"] or []))
        return [(F.lit(a is None) | (F.col("label") > F.lit(a))) & (F.lit(b is None) | (F.col("label") <= F.lit(b))) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    # labels go to their tasks with the ids of a cell beside them, and pairs are made there
    of_cell = lambda side, c: side.repartition("cell").groupBy("cell").agg(F.collect_set(c).alias(c))
    parts = max(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), new.count() // COUNTED)
    of_label = of_cell(new, "label").join(of_cell(old, "old_id").hint("merge"), "cell").select(F.explode("label").alias("label"), "old_id").repartition(parts, "label")
    pairs = of_label.select("label", F.explode("old_id").alias("old_id")).groupBy("label", "old_id").agg(F.count(F.lit(1)).alias("n"))
    several = written(pairs.filter("n > 1"))
    band = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16)).cast("int")  # 96 and more from 64 on
    sizes = sorted(several.groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["b"])
    left, top, held = sum(r["k"] for r in sizes), None, 0
    for i, r in enumerate(sizes):
        top, held = r["b"] if top is None else top, held + r["k"]
        if i == len(sizes) - 1 or held + sizes[i + 1]["k"] > max(SETTLED, left // 16):
            settle(several.filter(band.between(r["b"], top)), top == r["b"] < 64)
            left, top, held = left - held, None, 0
    ids = old.select("old_id").distinct().count()
    open_ids = lambda: found is None or found.count() < ids
    for part in sliced(new, [2.0**-i for i in range(6, 0, -1)]) if open_ids() else ():
        if not open_ids():
            break
        singles = free(new.filter(part)).distinct().join(free(old).distinct(), "cell")
        settle(singles.select("label", "old_id", F.lit(1).cast("long").alias("n")), True)
    return found if found is not None else several.select("label", "old_id")


def centroid(w: str = "n") -> list[Column]:
    """Weighted centre of the rows of a group."""
    return [(F.sum(F.col(c) * F.col(w)) / F.sum(w)).alias(c) for c in ("x", "y")]


def hull(points: DataFrame, key: str) -> DataFrame:
    """(key, hull): convex hull of (key, x, y) as a WKT polygon, line or point.

    Points of one key are reduced to the extremes of each column of the grid before they are
    brought together, so a group is as long as a source is wide.
    """
    import pandas as pd

    column = F.floor(F.col("x") / geo.CELL_M)
    ends = points.groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(key, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")).withColumn("_c", column)
    edge = ends.groupBy(key, "_c").agg(F.collect_list(F.struct("x", "y")).alias("p"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(p["x"], p["y"]) for row in group["p"] for p in row})
        chains = []
        for seq in (pts, pts[::-1]):
            chain: list[tuple[float, float]] = []
            for p in seq:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(p)
            chains += chain[:-1]
        ring = chains or pts
        text = lambda ps: ", ".join(f"{x:.3f} {y:.3f}" for x, y in ps)
        wkt = f"POINT ({text(ring)})" if len(ring) == 1 else f"LINESTRING ({text(ring)})" if len(ring) == 2 else f"POLYGON (({text([*ring, ring[0]])}))"
        return pd.DataFrame({key: [group[key].iloc[0]], "hull": [wkt]})

    return edge.groupBy(key).applyInPandas(one, f"{key} {points.schema[key].dataType.simpleString()}, hull string")
