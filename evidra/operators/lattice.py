"""Control cells: squares of a lattice in a ring around a core, judged by pixels and exclusions, thinned to one a block, and drawn by sector; samples by strata.

Coordinates are metres in a plane. Cells are named by ix and iy, their lower left corner over the size. Distances are found
in tiles of TILE by TILE cells, each against parts of about PART boxes at a time, and only the least distances of a cell leave a task: neither a
crowded tile nor a large core is one group, and pairs of cells and boxes are never rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut

#: The compass from the north, clockwise.
SECTORS = "N NE E SE S SW W NW".split()
TILE, PART = 64, 2048
CORNERS = ("c00", "c01", "c10", "c11")
BOX = ["x0", "y0", "x1", "y1"]


def snapped_frame(minx: Column, miny: Column, maxx: Column, maxy: Column, res: float, snap: float) -> Column:
    """struct(x0, y0, x1, y1, width, height): the frame widened to multiples of snap, and its size in pixels of res."""
    down, up = lambda c: F.floor(c / snap) * snap, lambda c: F.ceil(c / snap) * snap
    x0, y0, x1, y1 = down(minx), down(miny), up(maxx), up(maxy)
    pixels = lambda a, b: F.bround((b - a) / res).cast("long")
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), pixels(x0, x1).alias("width"), pixels(y0, y1).alias("height"))


def plain_frame(minx: Column, miny: Column, maxx: Column, maxy: Column, res: float) -> Column:
    """struct(x0, y1, width, height): pixels of res from the upper left corner, as many as come nearest to the frame."""
    pixels = lambda a, b: F.floor((b - a) / res + 0.5).cast("long")
    return F.struct(minx.alias("x0"), maxy.alias("y1"), pixels(minx, maxx).alias("width"), pixels(miny, maxy).alias("height"))


def sector(dx: Column, dy: Column) -> Column:
    """The eighth of the compass that a direction lies in, each centred on its name; no direction counts as north."""
    turn = F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, SECTORS)), (F.pmod(F.floor((turn + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def _beyond(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaps along one axis between the ranges [low, high] (down) and [a, b] (across)."""
    return np.maximum(0.0, np.maximum(a[None, :] - high[:, None], low[:, None] - b[None, :]))


def near_cells(boxes: DataFrame, size: float, reach: float) -> DataFrame:
    """ix, iy, near (of the whole square), centre and four corners: least distances to the boxes x0, y0, x1, y1, for all cells within reach of one.

    Boxes with a null or turned side take no part; equal boxes count once; points are boxes without area; no boxes, no cells."""
    side = TILE * size
    clean = boxes.select(*[F.col(c).cast("double").alias(c) for c in BOX]).where("x0 <= x1 and y0 <= y1").distinct()
    tile = lambda c, by: F.floor((c + by) / side)
    around = clean.withColumn("tx", F.explode(F.sequence(tile(F.col("x0"), -reach), tile(F.col("x1"), reach)))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0"), -reach), tile(F.col("y1"), reach))))
    counts = around.groupBy("tx", "ty").agg(F.ceil(F.count("*") / PART).alias("parts"))
    parted = around.join(counts, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64(*BOX), "parts"))

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(rows["tx"].iat[0]), int(rows["ty"].iat[0])
        x0, y0, x1, y1 = rows[BOX].to_numpy().T
        ix, iy = np.arange(TILE) + tx * TILE, np.arange(TILE) + ty * TILE
        grid = lambda i, low, high, a, b: _beyond((i + low) * size, (i + high) * size, a, b)
        kinds = {"near": (0, 1, 0, 1), "centre": (0.5, 0.5, 0.5, 0.5), "c00": (0, 0, 0, 0), "c01": (0, 0, 1, 1), "c10": (1, 1, 0, 0), "c11": (1, 1, 1, 1)}
        out = {"ix": np.repeat(ix, TILE), "iy": np.tile(iy, TILE)}
        for kind, (a, b, c, d) in kinds.items():
            gx, gy = grid(ix, a, b, x0, x1) ** 2, grid(iy, c, d, y0, y1) ** 2
            out[kind] = np.sqrt(np.concatenate([(gx[i] + gy).min(axis=1) for i in range(TILE)]))
        found = pd.DataFrame(out)
        return found[found["near"] <= reach]

    schema = "ix long, iy long, " + ", ".join(f"{c} double" for c in ("near", "centre", *CORNERS))
    # the boxes are few bytes and much work: a fixed number of partitions keeps them from being merged into one task
    parted = parted.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty", "part")
    found = parted.groupBy("tx", "ty", "part").applyInPandas(least, schema)
    return found.groupBy("ix", "iy").agg(*[F.min(c).alias(c) for c in ("near", "centre", *CORNERS)])


def ring_cells(core: DataFrame, size: float, inner: float, outer: float) -> DataFrame:
    """ix, iy, distance (of the centre): the cells that the core boxes leave `inner` free, with all four corners within `outer` of it."""
    return near_cells(core, size, outer).where((F.col("near") >= inner) & (F.greatest(*CORNERS) <= outer)).select("ix", "iy", F.col("centre").alias("distance"))


def class_shares(cells: DataFrame, pixels: DataFrame, classes: Sequence[str], size: float) -> DataFrame:
    """The cells with valid (pixels of a class at all) and the share of each class, null where no pixel is valid; pixels are x, y, class, placed by their centres."""
    place = lambda c: F.floor(F.col(c) / size).alias("i" + c)
    valid = pixels.where("class is not null and x is not null and y is not null").select(place("x"), place("y"), "class")
    counts = valid.groupBy("ix", "iy").agg(F.count("*").alias("valid"), *[F.count_if(F.col("class") == c).alias(f"_{c}") for c in classes])
    shares = counts.select("ix", "iy", "valid", *[(F.col(f"_{c}") / F.col("valid")).alias(f"share_{c}") for c in classes])
    return cells.join(shares, ["ix", "iy"], "left").withColumn("valid", F.coalesce("valid", F.lit(0)))


def without(cells: DataFrame, boxes: DataFrame, size: float, buffer: float) -> DataFrame:
    """The cells that no box comes within the buffer of (touching it counts)."""
    return cells.join(near_cells(boxes, size, buffer).select("ix", "iy"), ["ix", "iy"], "left_anti")


def in_sectors(cells: DataFrame, core: DataFrame, size: float) -> DataFrame:
    """The cells with the sector they lie in, seen from the core's middle: that of its boxes by area (by number if none has any; overlaps count twice)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    x, y = F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1")
    weighed = lambda c: F.coalesce(F.try_divide(F.sum(c * area), F.sum(area)), F.avg(c)) / 2
    middle = core.where("x0 <= x1 and y0 <= y1").agg(weighed(x).alias("_mx"), weighed(y).alias("_my"))
    seen = cells.crossJoin(F.broadcast(middle))  # one row
    centre = lambda c: (F.col(c) + 0.5) * size
    return seen.withColumn("sector", sector(centre("ix") - F.col("_mx"), centre("iy") - F.col("_my"))).drop("_mx", "_my")


def draw(seed: int | str, *columns: str) -> Column:
    """A place in a seeded order: the same at every run."""
    return F.md5(F.concat(F.concat_ws("_", *[F.col(c).cast("string") for c in columns]), F.lit(f"|{seed}")))


def thinned(cells: DataFrame, size: float, block: float, seed: int | str) -> DataFrame:
    """One cell of each block of that side, the first in the seeded order."""
    side = lambda c: F.floor(F.col(c) * size / block)
    rows = cells.groupBy(side("ix").alias("_bx"), side("iy").alias("_by")).agg(F.min_by(F.struct(*cells.columns), draw(seed, "ix", "iy")).alias("cell"))
    return rows.select("cell.*")


def _candidates(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The rows that can be among the first n of their group by _draw: whole buckets of it, up to the one that holds the nth; so a group with most of the rows is ranked from little more than n of them."""
    bucket = F.substring("_draw", 1, 3)
    counts = rows.groupBy(*by, bucket.alias("_bucket")).count()
    before = F.sum("count").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    kept = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n)
    return rows.withColumn("_bucket", bucket).join(kept.select(*by, "_bucket"), [*by, "_bucket"], "left_semi").drop("_bucket")


def by_sector(cells: DataFrame, n: int, seed: int | str) -> DataFrame:
    """About n cells, each sector's number in proportion to what it has and one at least, first ones of the seeded order; at most n, by sector, ix, iy. Cells without a sector take no part."""
    drawn = cut(cells.withColumn("_draw", draw(seed, "ix", "iy")))
    counts = drawn.groupBy("sector").count()
    total = counts.agg(F.sum("count").alias("_all"))
    quota = counts.crossJoin(F.broadcast(total)).select("sector", F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("count") / F.col("_all"))).alias("_quota"))
    place = F.row_number().over(Window.partitionBy("sector").orderBy("_draw"))
    first = _candidates(drawn, ["sector"], n).withColumn("_place", place)
    return first.join(F.broadcast(quota), "sector").where("_place <= _quota").select(*cells.columns).orderBy("sector", "ix", "iy").limit(n)


def root_sample(rows: DataFrame, strata: Sequence[str], unit: str, key: str, n: int, seed: int | str) -> DataFrame:
    """About n rows: strata share them by the root of their size, one each at least and none more than its size; what is left goes by the largest remainders, one a stratum.

    A unit stands at most once in a stratum, by its first key in the seeded order, so strata of few units give fewer. Null strata, units and keys are values
    like others. The strata, not the rows, are ranked in one task."""
    named = rows.withColumns({f"_s{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(strata)})
    by = [f"_s{i}" for i in range(len(strata))]
    sizes = named.groupBy(*by).count()
    roots = sizes.agg(F.sum(F.sqrt("count")).alias("_roots"))
    ideal = sizes.crossJoin(F.broadcast(roots)).withColumn("_ideal", F.sqrt("count") / F.col("_roots") * n)
    given = ideal.withColumn("_given", F.least("count", F.greatest(F.lit(1), F.floor("_ideal"))))
    rest = given.agg((F.lit(n) - F.sum("_given")).alias("_rest"))
    room = F.col("_given") < F.col("count")
    turn = F.row_number().over(Window.orderBy(F.when(room, F.col("_ideal") - F.floor("_ideal")).desc_nulls_last(), *by))
    shares = given.crossJoin(F.broadcast(rest)).withColumn("_turn", turn).select(*by, (F.col("_given") + F.when(room & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0)).alias("_share"))
    order = F.struct(draw(seed, key).alias("draw"), F.col(key).alias("key"))
    units = named.groupBy(*by, F.col(unit).alias("_unit")).agg(F.min_by(F.struct(*rows.columns), order).alias("row"), F.min(order).alias("_order"))
    first = _candidates(cut(units.withColumn("_draw", F.coalesce("_order.draw", F.lit("")))), by, n)
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_order")))
    return placed.join(F.broadcast(shares), by).where("_place <= _share").select("row.*")
