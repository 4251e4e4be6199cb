"""Boxes and points by grid buckets; polygons as arrays of points.

Things meet by an equi-join on the grid cells they touch, then the exact test; a pair that shares
several cells is kept in the one that holds its lower left common corner. Things at the very same place
are compared once, whatever their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut


#: Fixed value: uids of equal boxes that are held in one row.
BLOCK = 256


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def with_cells(df: DataFrame, size: float, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """A row per grid cell that a box touches: cx, cy."""
    columns = df.withColumn("cx", F.explode(_cells(F.col(x0), F.col(x1), size)))
    return columns.withColumn("cy", F.explode(_cells(F.col(y0), F.col(y1), size)))


def box_overlaps(boxes: DataFrame, size: float, least: float = 0.0) -> DataFrame:
    """uid_a, uid_b, area of each overlapping pair (uid_a < uid_b) of boxes (uid, x0, y0, x1, y1).

    Equal boxes meet others as one shape. Uids of a shape lie in blocks of BLOCK at most; pairs of blocks are dealt out before they become pairs of uids."""
    corners = ("x0", "y0", "x1", "y1")
    place = F.floor((F.row_number().over(Window.partitionBy(*corners).orderBy("uid")) - 1) / BLOCK)
    blocks = cut(boxes.where("uid is not null").withColumn("block", place).groupBy(*corners, "block").agg(F.collect_list("uid").alias("uids")))
    cells = with_cells(blocks.select(*corners).distinct(), size)
    a = cells.select("cx", "cy", *[F.col(c).alias(f"{c}_a") for c in corners])
    b = cells.select("cx", "cy", *[F.col(c).alias(f"{c}_b") for c in corners])
    left, low = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    width, height = F.least("x1_a", "x1_b") - left, F.least("y1_a", "y1_b") - low
    first = (F.floor(left / size) == F.col("cx")) & (F.floor(low / size) == F.col("cy"))
    shape = lambda side: F.struct(*[F.col(f"{c}_{side}") for c in corners])
    met = a.join(b, ["cx", "cy"]).where((shape("a") <= shape("b")) & (width > 0) & (height > 0) & first & (width * height > least))
    met = met.select(*[f"{c}_{s}" for s in "ab" for c in corners], (width * height).alias("area"), (shape("a") == shape("b")).alias("_same"))
    for s in "ab":
        met = met.join(blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in corners], F.col("block").alias(f"block_{s}"), F.col("uids").alias(f"uids_{s}")), [f"{c}_{s}" for c in corners])
    met = met.where("not _same or block_a <= block_b").select("area", (F.col("_same") & (F.col("block_a") == F.col("block_b"))).alias("_same"), "uids_a", "uids_b")
    pairs = met.repartition(F.hash("uids_a", "uids_b")).select("area", "_same", "uids_b", F.explode("uids_a").alias("a")).select("area", "_same", "a", F.explode("uids_b").alias("b"))
    return pairs.where("if(_same, a < b, a <> b)").select(F.least("a", "b").alias("uid_a"), F.greatest("a", "b").alias("uid_b"), "area")


def within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """id, target, distance of all targets (target, tx, ty) within the radius of points (id, x, y)."""
    near = targets.select("target", "tx", "ty", F.floor(F.col("tx") / radius).alias("cx"), F.floor(F.col("ty") / radius).alias("cy"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = points.select("id", "x", "y", F.explode(step).alias("dx")).select("*", F.explode(step).alias("dy")).select("id", "x", "y", (F.floor(F.col("x") / radius) + F.col("dx")).alias("cx"), (F.floor(F.col("y") / radius) + F.col("dy")).alias("cy"))
    distance = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2)) + F.pow(F.col("y") - F.col("ty"), F.lit(2)))
    return around.join(near, ["cx", "cy"]).withColumn("distance", distance).where(F.col("distance") <= radius).select("id", "target", "distance")


def within_counts(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """id, n, nearest: number of targets within the radius of each point that has any, and the least distance. Equal points and equal targets meet once."""
    places = points.select("x", "y").distinct().select(F.struct("x", "y").alias("id"), "x", "y")
    spots = targets.groupBy("tx", "ty").agg(F.count("*").alias("target"))
    near = within(places, spots, radius).groupBy("id").agg(F.sum("target").alias("n"), F.min("distance").alias("nearest")).select("id.x", "id.y", "n", "nearest")
    return points.join(near, ["x", "y"]).groupBy("id").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


def nearest(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """id, target, distance of the nearest target (smaller target on a tie): rings of doubled radius for points without one yet.

    The first ring is narrower than the radius where targets are dense. The rings end when they are as wide as all points and targets together, so every point has its target if
    there is any. Of equal points one is looked for, of equal targets the smallest."""
    spots = cut(targets.groupBy("tx", "ty").agg(F.min("target").alias("target")))
    rest, found = cut(points.select("x", "y").distinct().select(F.struct("x", "y").alias("id"), "x", "y")), None
    w = Window.partitionBy("id").orderBy("distance", "target")
    spread = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
    a, b = spread(rest, "x", "y"), spread(spots, "tx", "ty")
    lo, hi = [min((r[i] for r in (a, b) if r[i] is not None), default=0.0) for i in (0, 2)], [max((r[i] for r in (a, b) if r[i] is not None), default=0.0) for i in (1, 3)]
    width = math.hypot(hi[0] - lo[0], hi[1] - lo[1])
    if b[4] and (area := (b[1] - b[0]) * (b[3] - b[2]) if b[0] is not None and b[2] is not None else 0.0) > 0:
        radius = min(radius, math.sqrt(area / b[4]))
    while True:
        hit = cut(within(rest, spots, radius).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))
        found = hit if found is None else found.unionByName(hit)
        rest = cut(rest.join(hit.select("id"), "id", "left_anti"))
        if radius > width or rest.limit(1).count() == 0:
            break
        radius *= 2
    best = F.min(F.struct("distance", "target"))
    met = points.join(found.select("id.x", "id.y", "target", "distance"), ["x", "y"]).groupBy("id").agg(best.alias("b"))
    return met.select("id", "b.target", "b.distance")


def polygon_area(ring: Column) -> Column:
    """Shoelace area of an array of struct(x, y), closed or not."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), F.lit(1)))
    return F.abs(F.aggregate(F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)) / 2


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies within a ring: crossings of the ray to the right are odd in number."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, F.lit(1), F.lit(1)))
    crosses = F.zip_with(ring, turned, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda a, v: a + v) % 2 == 1


def extent(df: DataFrame, *group: str) -> DataFrame:
    """group, x0, y0, x1, y1: the box around all boxes."""
    return df.groupBy(*group).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
