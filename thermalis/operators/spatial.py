"""Distance joins and clusters on the plane, as equi-joins on square buckets.

The right side is copied to the buckets around it and joined by key, so a join costs what its
neighbourhoods hold. Sizes that Spark estimates leave the copies out, so these joins ask for a merge: nothing
that grows with a table is broadcast through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: What a squared bound may grow by, for rounding; it only adds places that are then measured.
SLACK = 1 + 1e-9
#: Side of a square, in radii, all of whose points lie within the radius of one another; squares along a tile.
SQUARE, TILE = 0.7071, 6


def bucket(x: Column, y: Column, side: float) -> tuple[Column, Column]:
    return F.floor(x / side).cast("long"), F.floor(y / side).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keep: str = "d <= radius", same: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (left columns, right columns prefixed r_, d) within `radius`. Both sides have x and y.

    keep: "d <= radius" or "d < radius". same: columns in which the pair agrees, which are part of
    the join's key. Buckets are twice as wide as `radius`, so a right row goes to the 4 of them that it can reach.
    """
    side, reach = 2 * radius, radius * (1 + 1e-9)
    bx, by = bucket(F.col("x"), F.col("y"), side)
    lhs = left.withColumns({"_bx": bx, "_by": by})
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side).cast("long"), F.floor((F.col(c) + reach) / side).cast("long")))
    rhs = right.withColumn("_bx", touched("x")).withColumn("_by", touched("y"))
    rhs = rhs.select(*[F.col(c).alias(c if c in ("_bx", "_by", *same) else f"r_{c}") for c in rhs.columns]).hint("merge")
    d = F.sqrt(F.pow(F.col("x") - F.col("r_x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("r_y"), F.lit(2.0)))
    return lhs.join(rhs, ["_bx", "_by", *same]).withColumn("d", d).filter(F.expr(keep.replace("radius", repr(float(radius))))).drop("_bx", "_by")


def nearest(left: DataFrame, right: DataFrame, radius: float | Column, most: float, key: str, value: str, order: str) -> DataFrame:
    """left with `value` of its nearest right row closer than `radius` (at most `most` metres), and d; null where there is none.

    key: a unique column of left. Equal distances: the least `order` of right.
    """
    reach = F.lit(float(radius)) if isinstance(radius, int | float) else radius
    best = near_pairs(left, right, most, "d < radius").filter(F.col("d") < reach).groupBy(key).agg(F.min(F.struct("d", f"r_{order}", f"r_{value}")).alias("m"))
    return left.join(best, key, "left").withColumns({value: F.col(f"m.r_{value}"), "d": F.col("m.d")}).drop("m")


def _square_of_distance(cx: Column, cy: Column, low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """Squared distance of a point to a box, 0 inside."""
    dx = F.greatest(low_x - cx, cx - high_x, F.lit(0.0))
    dy = F.greatest(low_y - cy, cy - high_y, F.lit(0.0))
    return dx * dx + dy * dy


def _surely_within(cx: Column, cy: Column) -> Column:
    """Squared distance within which a tight box (x0, x1, y0, y1) has a place for sure, as each of its sides touches one."""
    near = lambda c, a, b: F.least(F.pow(c - F.col(a), F.lit(2.0)), F.pow(c - F.col(b), F.lit(2.0)))
    far = lambda c, a, b: F.greatest(F.pow(c - F.col(a), F.lit(2.0)), F.pow(c - F.col(b), F.lit(2.0)))
    return F.least(near(cx, "x0", "x1") + far(cy, "y0", "y1"), far(cx, "x0", "x1") + near(cy, "y0", "y1"))


def nearest_any(left: DataFrame, right: DataFrame, key: str, value: str, order: str, first: float = 1000.0) -> DataFrame:
    """left with `value` of its nearest right row, however far, and d; null only if right is empty. Both have x and y.

    Places lie in boxes of side `first`, 4 times that, and so on. For each square of left rows the boxes are opened level by
    level: first towards the place nearest to its middle, then towards every place that some point of the square may have
    nearer than that one. Such a place is nearer to a corner, too, since which of two places is nearer changes at a line.
    So a square keeps few places however far they are. key: a unique column of left. Equal distances: the least `order` of right.
    """
    at = written(right.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("b")).withColumns(dict(zip(("_i", "_j"), bucket(F.col("x"), F.col("y"), first), strict=True))))
    ends = at.agg(F.max("_i") - F.min("_i"), F.max("_j") - F.min("_j")).first()
    if ends[0] is None:
        return left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "d": F.lit(None).cast("double")})
    top = 0
    while max(ends) >> 2 * top > 1:
        top += 1
    levels = at.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns({c: F.floor(F.col(c) / F.pow(F.lit(4.0), "level")).cast("long") for c in ("_i", "_j")})
    boxes = written(levels.groupBy("level", "_i", "_j").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    sx, sy = bucket(F.col("x"), F.col("y"), first)
    placed = left.select(key, "x", "y", sx.alias("_sx"), sy.alias("_sy"))
    square = written(placed.groupBy("_sx", "_sy").agg(F.min("x").alias("a0"), F.max("x").alias("a1"), F.min("y").alias("b0"), F.max("y").alias("b1")).filter("a0 IS NOT NULL AND b0 IS NOT NULL"))
    whose, box = ["_sx", "_sy"], ("x0", "x1", "y0", "y1")

    def opened(rows: DataFrame, level: int, what: list[str]) -> DataFrame:
        """rows with the boxes of a level in theirs of the level above."""
        inner = boxes.filter(F.col("level") == level).drop("level")
        if level == top:
            return rows.crossJoin(inner)
        parent = inner.withColumns({"_u": F.floor(F.col("_i") / 4).cast("long"), "_v": F.floor(F.col("_j") / 4).cast("long")})
        return rows.select(*what, F.col("_i").alias("_u"), F.col("_j").alias("_v")).join(parent.hint("merge"), ["_u", "_v"]).drop("_u", "_v")

    mx, my = (F.col("a0") + F.col("a1")) / 2, (F.col("b0") + F.col("b1")) / 2
    open_ = square.select(*whose, mx.alias("mx"), my.alias("my"), F.lit(float("inf")).alias("h"))
    for level in range(top, -1, -1):
        seen = opened(open_, level, [*whose, "mx", "my", "h"]).withColumn("lo", _square_of_distance(F.col("mx"), F.col("my"), *map(F.col, box))).filter(F.col("lo") <= F.col("h") * SLACK)
        best = F.min(F.least("h", _surely_within(F.col("mx"), F.col("my")))).over(Window.partitionBy(*whose))
        open_ = written(seen.withColumn("h", best).filter(F.col("lo") <= F.col("h") * SLACK).select(*whose, "mx", "my", "h", "_i", "_j"))
    away = F.pow(F.col("x") - F.col("mx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("my"), F.lit(2.0))
    middle = open_.join(at.select("x", "y", "_i", "_j").hint("merge"), ["_i", "_j"]).groupBy(*whose).agg(F.min(F.struct(away.alias("d"), "x", "y")).alias("m"))
    corners = [(a, b) for a in ("a0", "a1") for b in ("b0", "b1")]
    reach = [(F.pow(F.col(a) - F.col("m.x"), F.lit(2.0)) + F.pow(F.col(b) - F.col("m.y"), F.lit(2.0))) * SLACK for a, b in corners]
    sides = ["a0", "a1", "b0", "b1", "u0", "u1", "u2", "u3"]
    open_ = square.join(middle.hint("merge"), whose).select(*whose, "a0", "a1", "b0", "b1", *[u.alias(f"u{i}") for i, u in enumerate(reach)])

    def in_reach(*sides_: str) -> Column:
        near = [_square_of_distance(F.col(a), F.col(b), *map(F.col, sides_)) <= F.col(f"u{i}") for i, (a, b) in enumerate(corners)]
        return reduce(Column.__or__, near)

    for level in range(top, -1, -1):
        open_ = written(opened(open_, level, [*whose, *sides]).filter(in_reach(*box)).select(*whose, *sides, "_i", "_j"))
    few = open_.join(at.hint("merge"), ["_i", "_j"]).filter(in_reach("x", "x", "y", "y")).select(*whose, F.col("x").alias("px"), F.col("y").alias("py"), "b")
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0)))
    found = placed.join(few.hint("merge"), whose).groupBy(key).agg(F.min(F.struct(d.alias("d"), "b.o", "b.v")).alias("m"))
    return left.join(found.hint("merge"), key, "left").withColumns({value: F.col("m.v"), "d": F.col("m.d")}).drop("m")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): comp is the least id reachable over edges (a, b), both directions being given.

    In each round a node stands for itself or the neighbour that comes first by a hash of the round, edges go over to those that
    stand for their ends, and edges within one are dropped. So edges shrink by a share each round, whatever the order of ids
    along a chain. Whom a node stands for is kept for those with edges only, and the rounds are put together at the end, from the
    last to the first. Rounds are written to the shared folder, which cuts the lineage.
    """
    edges = written(edges.select("a", "b").filter("a != b").distinct())
    rounds, turn = [], 0
    while edges.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("rep"))  # noqa: B023, E731
        chosen = edges.groupBy("a").agg(F.min(rank("b")).alias("m"))
        first = written(chosen.select(F.col("a").alias("node"), F.least("m", rank("a"))["rep"].alias("rep")))
        of = lambda c: first.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))  # noqa: B023, E731
        rounds.append(first)
        edges = written(edges.join(of("a"), "a").join(of("b"), "b").filter("a_rep != b_rep").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct())
        turn += 1
    if not rounds:
        return nodes.select("id", F.col("id").alias("comp"))
    last = rounds.pop()
    while rounds:
        later = last.select(F.col("node").alias("rep"), F.col("rep").alias("at_last"))
        last = written(rounds.pop().join(later, "rep", "left").select("node", F.coalesce("at_last", "rep").alias("rep")))
    labels = nodes.select("id").join(last.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("rep", "id").alias("comp"))
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return labels.join(least, "comp").select("id", F.col("least").alias("comp"))


def squares(points: DataFrame, radius: float, same: tuple[str, ...] = ()) -> DataFrame:
    """points with `square`: the least id of those in the same square (and equal in `same`). Points of a square lie within `radius` of one another."""
    sx, sy = bucket(F.col("x"), F.col("y"), radius * SQUARE)
    marked = points.withColumns({"_sx": sx, "_sy": sy})
    least = marked.groupBy("_sx", "_sy", *same).agg(F.min("id").alias("square"))
    return marked.join(least, ["_sx", "_sy", *same]).drop("_sx", "_sy")


def components_within(points: DataFrame, radius: float, same: tuple[str, ...] = ()) -> DataFrame:
    """(id, comp) of points (id, x, y): comp is the least id reachable over steps of at most `radius` between points equal in `same`.

    Squares stand for their points, so pairs are only made between squares, once for each different
    place, and one row a pair of squares is kept; the pairs of a dense square are never made.
    """
    at = written(squares(points, radius, same).select("id", "x", "y", "square", *same))
    places = at.groupBy("x", "y", "square", *same).agg(F.lit(1).alias("_"))
    links = near_pairs(places, places, radius, same=same).filter("square != r_square").select(F.col("square").alias("a"), F.col("r_square").alias("b")).distinct()
    comp = connected_components(at.select(F.col("square").alias("id")).distinct(), links)
    return at.select("id", "square").join(comp.withColumnRenamed("id", "square"), "square").select("id", "comp")


def neighbours_within(points: DataFrame, radius: float, weight: str | None = None) -> DataFrame:
    """(id, n) of points (id, x, y): how many points, or how much weight, lie within `radius`, the point itself included.

    A square's own sum needs no pairs; between squares equal places are summed first and pairs are
    added up where they are made.
    """
    of = F.sum(weight) if weight else F.count(F.lit(1))
    at = written(squares(points, radius))
    inside = at.groupBy("square").agg(of.alias("inside"))
    places = at.groupBy("x", "y", "square").agg(of.alias("w"))
    beside = near_pairs(places, places, radius).filter("square != r_square").groupBy("x", "y", "square").agg(F.sum("r_w").alias("beside"))
    return at.join(inside, "square").join(beside, ["x", "y", "square"], "left").select("id", (F.col("inside") + F.coalesce("beside", F.lit(0))).alias("n"))


def _tiles(x: Column, y: Column, side: float) -> tuple[Column, Column]:
    """The tile of TILE by TILE squares of `side` in which a place lies, so that a square lies in one tile."""
    return tuple(F.floor(c / TILE).cast("long") for c in bucket(x, y, side))


def _beside(places: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Every row of places (x, y, _sx, _sy, and its tile _tx, _ty) with those of others (r_x, r_y) of the tile: `own` in the same square, `near` in another one and within radius.

    others go to every tile that they reach, a little more than 2 of them. What comes out is still parted by tiles, so sums by
    place or square need no shuffle if the tile is among their keys.
    """
    side, reach = radius * SQUARE, radius * (1 + 1e-9)
    x, y, rx, ry = map(F.col, ("x", "y", "r_x", "r_y"))
    low, high = _tiles(rx - reach, ry - reach, side), _tiles(rx + reach, ry + reach, side)
    copies = others.withColumn("_tx", F.explode(F.sequence(low[0], high[0]))).withColumn("_ty", F.explode(F.sequence(low[1], high[1])))
    qx, qy = bucket(rx, ry, side)
    within = F.sqrt(F.pow(x - rx, F.lit(2.0)) + F.pow(y - ry, F.lit(2.0))) <= float(radius)
    own = (F.col("_sx") == qx) & (F.col("_sy") == qy)
    return places.join(copies.hint("merge"), ["_tx", "_ty"]).withColumns({"own": own, "near": ~own & within})


def weighted_dbscan(points: DataFrame, eps: float, least: float) -> DataFrame:
    """(id, core, cluster) of points (id, x, y, weight): density clusters at distance eps, inclusive.

    A point is a core if the weights within eps, its own included, reach `least`. A cluster's name is
    its least core id; a border point takes the least cluster in reach; noise has null.

    Points of one place fare alike, so all is found for places. Those of a square lie within eps of one another. A node is a
    square's core places together (named by their least id), or a place that is none; one join finds the nodes beside each.
    """
    side, tile, square, place = eps * SQUARE, ["_tx", "_ty"], ["_sx", "_sy"], ["x", "y"]
    in_tiles = lambda t: t.withColumns(dict(zip(tile, _tiles(F.col("x"), F.col("y"), side), strict=True)))
    in_squares = lambda t: t.withColumns(dict(zip(square, bucket(F.col("x"), F.col("y"), side), strict=True)))
    of_square = Window.partitionBy(*tile, *square)
    parted = in_tiles(points.select("id", "x", "y", "weight")).repartition(*tile)
    places = in_squares(parted.groupBy(*tile, *place).agg(F.min("id").alias("first"), F.sum("weight").alias("w"))).withColumn("inside", F.sum("w").over(of_square))
    weights = points.groupBy(*place).agg(F.sum("weight").alias("r_w")).select(F.col("x").alias("r_x"), F.col("y").alias("r_y"), "r_w")
    # a place meets itself, so none is lost
    met = _beside(places, weights, eps).filter("near OR (x = r_x AND y = r_y)").groupBy(*tile, *square, *place)
    summed = met.agg(F.min("first").alias("first"), (F.min("inside") + F.sum(F.when(F.col("near"), F.col("r_w")).otherwise(0))).alias("n"))
    judged = summed.withColumn("core", F.col("n") >= least).withColumn("node", F.when(F.col("core"), F.min(F.when(F.col("core"), F.col("first"))).over(of_square)).otherwise(F.col("first")))
    nodes = written(judged.select(*place, "core", "node"))
    cores = nodes.filter("core").select(F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("node").alias("r_node"))
    links = written(_beside(in_squares(in_tiles(nodes)), cores, eps).filter("near OR (own AND NOT core)").select(*tile, "core", "node", "r_node").distinct().drop(*tile))
    comp = written(connected_components(nodes.filter("core").select(F.col("node").alias("id")).distinct(), links.filter("core").select(F.col("node").alias("a"), F.col("r_node").alias("b"))))
    border = links.filter("NOT core").join(comp.select(F.col("id").alias("r_node"), "comp"), "r_node").groupBy("node").agg(F.min("comp").alias("cluster"))
    clusters = comp.select(F.col("id").alias("node"), F.col("comp").alias("cluster")).union(border)
    return points.select("id", *place).join(nodes.join(clusters, "node", "left").select(*place, "core", "cluster"), place).select("id", "core", "cluster")


def split_wide(points: DataFrame, label: str, most_km: float) -> DataFrame:
    """Clusters wider than most_km are parted by a grid; `part` is 0 for the others, so (label, part) names a cluster.

    Two wide clusters in one tile share its part, whose label is null.
    """
    extent = points.groupBy(label).agg((F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 1000 > most_km).alias("_wide"))
    tile = most_km * 1000 / 2**0.5
    key = F.floor(F.col("x") / tile).cast("long") * 100_000 + F.floor(F.col("y") / tile).cast("long") + 1
    return points.join(extent, label).withColumn("part", F.when(F.col("_wide"), key).otherwise(0)).withColumn(label, F.when(~F.col("_wide"), F.col(label))).drop("_wide")
