"""Polygons as trapezoids: overlap, what lies outside, coverage, and dissolved area.

A polygon is an array of rings, each an array of struct(x, y), closed or not. A place is inside if an odd number of rings hold it, so holes
and several parts need no marks; rings must not cross themselves. Every polygon is cut once, by Arrow batches, into trapezoids
with two upright sides that lie within one grid cell each: x0, x1, and the heights of the lower (l0, l1) and upper side (u0, u1) at either end.
All that follows works on those rows: areas are sums, and two polygons meet by an equi-join on the cell, where the common area of two
trapezoids is an expression. A dissolve is a union cell by cell, so a group is spread over as many tasks as it has cells.

Edge cases: polygons that are null, empty or flat have no trapezoids (and no area); points with a null or non-finite coordinate are left out;
repeated points and rings given twice are as the odd-even rule has them; keys that repeat are one polygon of all their trapezoids, so areas add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut

SIDES = ("x0", "x1", "l0", "l1", "u0", "u1")
RINGS = "array<array<struct<x:double,y:double>>>"
#: Points of the polygons taken at a time; parts of a cell narrower than this share of its length are rounding and dropped; times that a cell is halved.
POINTS, SLIVER, HALVINGS = 1 << 16, 1e-12, 12


def edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, and points (x, y) of either end, of every edge of a column of rings."""
    n_rings = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rings = column.flatten()
    n_points = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    points = rings.flatten()
    xy = np.stack([points.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(points) else np.zeros((0, 2))
    ring = np.repeat(np.arange(len(rings)), n_points)
    good = np.isfinite(xy).all(axis=1)
    xy, ring = xy[good], ring[good]
    first = np.searchsorted(ring, ring)
    last = np.searchsorted(ring, ring, side="right") - 1
    following = np.where(np.arange(len(ring)) == last, first, np.arange(len(ring)) + 1)
    return np.repeat(np.arange(len(column)), n_rings)[ring] if len(ring) else np.zeros(0, np.int64), xy, xy[following]


def along(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Height at x of the line from a to b (points in rows); exact at both ends."""
    share = (x - a[:, 0]) / (b[:, 0] - a[:, 0])
    return np.where(x == b[:, 0], b[:, 1], a[:, 1] + share * (b[:, 1] - a[:, 1]))


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as many lines as counted: number of the row, and of the line within it."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def decompose(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and sides of the trapezoids between each owner's edges: strips between neighbouring points, each parted by its edges from below."""
    slanted = a[:, 0] != b[:, 0]
    owner, a, b = owner[slanted], a[slanted], b[slanted]
    turned = a[:, 0] > b[:, 0]
    a, b = np.where(turned[:, None], b, a), np.where(turned[:, None], a, b)
    who, x = np.concatenate([owner, owner]), np.concatenate([a[:, 0], b[:, 0]])
    order = np.lexsort((x, who))
    new = np.r_[True, (np.diff(who[order]) != 0) | (np.diff(x[order]) != 0)][: len(order)]
    event = np.empty(len(order), np.int64)
    event[order] = np.cumsum(new) - 1
    at = x[order][new]
    edge, nth = spread(event[len(owner) :] - event[: len(owner)])
    strip = event[: len(owner)][edge] + nth
    left, right = at[strip], at[strip + 1] if len(strip) else at[strip]
    y0, y1 = along(a[edge], b[edge], left), along(a[edge], b[edge], right)
    order = np.lexsort((y0 + y1, strip))
    low, up = order[::2], order[1::2]  # a closed ring has an even number of edges in each strip
    return owner[edge[low]], np.stack([left[low], right[low], y0[low], y1[low], y0[up], y1[up]], axis=1)


def clip(sides: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the trapezoid, cell (cx, cy) and sides of its parts within each grid cell."""
    first = np.floor(sides[:, 0] / size)
    row, nth = spread(np.maximum(np.ceil(sides[:, 1] / size) - first, 1).astype(np.int64))
    cx = first[row] + nth
    s = sides[row]
    left, right = np.maximum(s[:, 0], cx * size), np.minimum(s[:, 1], (cx + 1) * size)
    low = np.stack([s[:, [0, 2]], s[:, [1, 3]]], axis=1)
    up = np.stack([s[:, [0, 4]], s[:, [1, 5]]], axis=1)
    height = lambda line, x: along(line[:, 0], line[:, 1], x)
    bottom = np.floor(np.minimum(height(low, left), height(low, right)) / size)
    top = np.ceil(np.maximum(height(up, left), height(up, right)) / size)
    piece, nth = spread(np.maximum(top - bottom, 1).astype(np.int64))
    cy = bottom[piece] + nth
    row, cx, left, right, low, up = row[piece], cx[piece], left[piece], right[piece], low[piece], up[piece]
    # where either side enters or leaves the cell, it bends
    bends = [left, right]
    for line in (low, up):
        for y in (cy * size, (cy + 1) * size):
            d0, d1 = line[:, 0, 1] - y, line[:, 1, 1] - y
            with np.errstate(divide="ignore", invalid="ignore"):
                x = line[:, 0, 0] + (line[:, 1, 0] - line[:, 0, 0]) * d0 / (d0 - d1)
            bends.append(np.clip(np.where(np.isfinite(x), x, left), left, right))
    bends = np.sort(np.stack(bends, axis=1), axis=1)
    out = []
    for i in range(bends.shape[1] - 1):
        a, b = bends[:, i], bends[:, i + 1]
        inside = [np.clip(height(line, x), cy * size, (cy + 1) * size) for line in (low, up) for x in (a, b)]
        part = np.stack([a, b, *inside], axis=1)
        keep = (b - a > SLIVER * size) & (part[:, 4] + part[:, 5] > part[:, 2] + part[:, 3])
        out.append((row[keep], cx[keep].astype(np.int64), cy[keep].astype(np.int64), part[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def union(sides: np.ndarray) -> np.ndarray:
    """Trapezoids that cover the same places once: strips between all ends and crossings, where runs of overlapping heights become one."""
    n = len(sides)
    if n < 2:
        return sides
    a = np.concatenate([sides[:, [0, 2]], sides[:, [0, 4]]])
    b = np.concatenate([sides[:, [1, 3]], sides[:, [1, 5]]])
    i, j = np.triu_indices(2 * n, 1)
    left, right = np.maximum(a[i, 0], a[j, 0]), np.minimum(b[i, 0], b[j, 0])
    meet = left < right
    i, j, left, right = i[meet], j[meet], left[meet], right[meet]
    d0, d1 = along(a[i], b[i], left) - along(a[j], b[j], left), along(a[i], b[i], right) - along(a[j], b[j], right)
    crossing = d0 * d1 < 0
    x = np.unique(np.concatenate([sides[:, 0], sides[:, 1], (left + (right - left) * d0 / np.where(d0 == d1, 1, d0 - d1))[crossing]]))
    begin = np.searchsorted(x, sides[:, 0])
    which, nth = spread(np.searchsorted(x, sides[:, 1]) - begin)
    strip = begin[which] + nth
    middle = (x[strip] + x[strip + 1]) / 2
    low, up = along(a[which], b[which], middle), along(a[which + n], b[which + n], middle)
    order = np.lexsort((low, strip))
    which, strip, low, up = which[order], strip[order], low[order], up[order]
    rank = np.empty(len(up), np.int64)
    rank[np.argsort(up, kind="stable")] = np.arange(len(up))
    reach = np.maximum.accumulate(strip * len(up) + rank) - strip * len(up)  # rank of the highest upper side so far
    by_rank = np.argsort(rank)
    new = np.r_[True, (np.diff(strip) != 0) | (low[1:] > up[by_rank[reach[:-1]]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(new) - 1]
    lower, upper, at = which[first], which[by_rank[reach[last]]], strip[first]
    order = np.lexsort((at, upper, lower))
    lower, upper, at = lower[order], upper[order], at[order]
    new = np.r_[True, (np.diff(lower) != 0) | (np.diff(upper) != 0) | (np.diff(at) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(new) - 1]
    x0, x1, lower, upper = x[at[first]], x[at[last] + 1], lower[first], upper[first]
    heights = [along(a[k], b[k], v) for k in (lower, upper + n) for v in (x0, x1)]
    return np.stack([x0, x1, *heights], axis=1)


def area() -> Column:
    """Area of a row's trapezoid."""
    return (F.col("x1") - F.col("x0")) * (F.col("u0") - F.col("l0") + F.col("u1") - F.col("l1")) / 2


def pieces(df: DataFrame, rings: str, size: float, keep: Sequence[str]) -> DataFrame:
    """keep, cx, cy and the sides of the trapezoids of every polygon within each grid cell of `size` (best a power of two)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_rings")
            weight = np.cumsum(np.bincount(edges(column)[0], minlength=batch.num_rows) + 1) // POINTS
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(weight)) + 1):
                some = batch.slice(int(part[0]), len(part)) if len(part) else batch.slice(0, 0)
                owner, sides = decompose(*edges(some.column("_rings")))
                row, cx, cy, sides = clip(sides, size)
                columns = [some.column(c).take(pa.array(owner[row])) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cx), pa.array(cy), *map(pa.array, sides.T)], [*keep, "cx", "cy", *SIDES])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "cx long", "cy long", *(f"{s} double" for s in SIDES)])
    return df.select(*keep, F.col(rings).cast(RINGS).alias("_rings")).mapInArrow(cut_up, schema)


def common_area(a: str, b: str) -> Column:
    """Area that two trapezoids share; their sides are columns with the endings a and b.

    Between the places where two of their four lines cross, the common height is linear, so its value half-way counts."""
    c = lambda name, end: F.col(f"{name}{end}")
    left, right = F.greatest(c("x0", a), c("x0", b)), F.least(c("x1", a), c("x1", b))

    def at(kind: str, end: str, x: Column) -> Column:
        y0, y1, x0, x1 = c(f"{kind}0", end), c(f"{kind}1", end), c("x0", end), c("x1", end)
        return F.when(x == x1, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    def crossing(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
        d0, d1 = p[0] - q[0], p[1] - q[1]
        return F.when(d0 * d1 < 0, d0 / (d0 - d1)).otherwise(F.lit(0.0))

    lines = F.struct(*[F.struct(at(k, e, left).alias("_1"), at(k, e, right).alias("_2")).alias(f"{k}{e}") for k in ("l", "u") for e in (a, b)], (right - left).alias("width"))

    def measure(s: Column) -> Column:
        line = {(k, e): (s[f"{k}{e}"]["_1"], s[f"{k}{e}"]["_2"]) for k in ("l", "u") for e in (a, b)}
        bends = F.array_sort(F.array(F.lit(0.0), F.lit(1.0), *[crossing(line[p], line[q]) for p, q in ((("l", a), ("l", b)), (("u", a), ("u", b)), (("l", a), ("u", b)), (("l", b), ("u", a)))]))
        strips = F.zip_with(F.slice(bends, 1, 5), F.slice(bends, 2, 5), lambda f, t: F.struct(((f + t) / 2).alias("m"), (t - f).alias("w")))

        def add(total: Column, strip: Column) -> Column:
            y = {k: v[0] + (v[1] - v[0]) * strip["m"] for k, v in line.items()}
            return total + F.greatest(F.lit(0.0), F.least(y["u", a], y["u", b]) - F.greatest(y["l", a], y["l", b])) * strip["w"]

        return F.aggregate(strips, F.lit(0.0), add) * s["width"]

    touch = (left < right) & (F.least(F.greatest(c("u0", a), c("u1", a)), F.greatest(c("u0", b), c("u1", b))) > F.greatest(F.least(c("l0", a), c("l1", a)), F.least(c("l0", b), c("l1", b))))
    return F.when(touch, F.element_at(F.transform(F.array(lines), measure), 1)).otherwise(0.0)


def meetings(a: DataFrame, b: DataFrame, on: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """All columns of a and b (pieces; other names must differ) and `common` of the trapezoids that share some area; on: columns that must agree too."""
    left, right = a.withColumnsRenamed({s: f"{s}_a" for s in SIDES}), b.withColumnsRenamed({s: f"{s}_b" for s in SIDES})
    met = left.join(right, ["cx", "cy", *on])
    met = met.where(where) if where is not None else met
    return met.withColumn("common", common_area("_a", "_b")).where("common > 0").drop(*[f"{s}_{e}" for s in SIDES for e in "ab"])


def overlaps(parts: DataFrame, uid: str, least: float = 0.0) -> DataFrame:
    """uid_a, uid_b, area of every pair (uid_a < uid_b) of polygons that share more than `least`."""
    a, b = (parts.select(F.col(uid).alias(f"uid_{e}"), "cx", "cy", *SIDES) for e in "ab")
    found = meetings(a, b, where=F.col("uid_a") < F.col("uid_b")).groupBy("uid_a", "uid_b").agg(F.sum("common").alias("area"))
    return found.where(F.col("area") > least)


def outside(parts: DataFrame, uid: str, frames: DataFrame, on: Sequence[str], least: float = 0.0) -> DataFrame:
    """uid, on, area, outside, outside_pct of polygons of which more than `least` lies outside the frames with the same `on`.

    Polygons without a frame are left out. Frames of one key must not overlap (dissolve them else)."""
    whole = parts.groupBy(uid, *on).agg(F.sum(area()).alias("area"))
    inside = meetings(parts.select(uid, *on, "cx", "cy", *SIDES), frames.select(*on, "cx", "cy", *SIDES), on).groupBy(uid, *on).agg(F.sum("common").alias("inside"))
    framed = whole.join(frames.select(*on).distinct(), list(on), "left_semi").join(inside, [uid, *on], "left")
    rest = framed.select(uid, *on, "area", F.greatest(F.lit(0.0), F.col("area") - F.coalesce("inside", F.lit(0.0))).alias("outside"))
    return rest.where(F.col("outside") > least).withColumn("outside_pct", F.when(F.col("area") > 0, 100 * F.col("outside") / F.col("area")))


def coverage(plots: DataFrame, plot: str, parts: DataFrame, uid: str, states: DataFrame, by: Sequence[str]) -> DataFrame:
    """plot, by, state, share, coverage: parts of each plot's area under a state, and under any polygon (1 at most).

    plots and parts: pieces by plot and by uid; states: uid, by, state."""
    whole = plots.groupBy(plot).agg(F.sum(area()).alias("whole"))
    met = meetings(plots.select(plot, "cx", "cy", *SIDES), parts.select(uid, "cx", "cy", *SIDES)).groupBy(plot, uid).agg(F.sum("common").alias("common"))
    met = met.join(whole, plot).withColumn("part", F.col("common") / F.col("whole"))
    covered = met.groupBy(plot).agg(F.least(F.lit(1.0), F.sum("part")).alias("coverage"))
    return met.join(states, uid).groupBy(plot, *by, "state").agg(F.sum("part").alias("share")).join(covered, plot)


def dissolved(parts: DataFrame, by: Sequence[str], size: float, most: int = 256) -> DataFrame:
    """by, side, cx, cy and the sides of trapezoids that cover each group's places once; side: length of the grid cell that cx and cy count.

    A cell with more than `most` trapezoids of a group is first reduced in chunks of about that many (what lies on one another melts), and the rest of it is dealt
    to four cells of half the length (what lies side by side parts), until no cell holds more; what still meets in a cell after HALVINGS of them is united there. Trapezoids that repeat in a group count once from the start."""
    cell, kinds = [*by, "side", "cx", "cy"], dict(parts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "side double", "cx long", "cy long", *(f"{s} double" for s in SIDES)])

    def frame(pdf: pd.DataFrame, sides: np.ndarray, side: float, cx, cy) -> pd.DataFrame:
        out = pd.DataFrame(sides, columns=list(SIDES)).assign(side=side, cx=cx, cy=cy)
        for c in by:
            out[c] = pd.Series([pdf[c].iloc[0]] * len(out), dtype=pdf[c].dtype)
        return out[[*cell, *SIDES]]

    def melt(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(pdf, union(pdf[list(SIDES)].to_numpy()), pdf["side"].iloc[0], pdf["cx"].iloc[0], pdf["cy"].iloc[0])

    def melt_and_deal(pdf: pd.DataFrame) -> pd.DataFrame:
        half = pdf["side"].iloc[0] / 2
        _, cx, cy, sides = clip(union(pdf[list(SIDES)].to_numpy()), half)
        return frame(pdf, sides, half, cx, cy)

    rows = cut(parts.select(*by, F.lit(float(size)).alias("side"), "cx", "cy", *SIDES).dropDuplicates())
    for _ in range(HALVINGS):
        crowded = cut(rows.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
        if crowded.limit(1).count() == 0:
            break
        same = [rows[c].eqNullSafe(crowded[c]) for c in cell]
        busy = rows.join(crowded, same, "inner").select(*[rows[c] for c in (*cell, *SIDES)], "_n")
        dealt = busy.withColumn("_part", F.pmod(F.xxhash64(*SIDES), F.ceil(F.col("_n") / most))).drop("_n").groupBy(*cell, "_part").applyInPandas(lambda pdf: melt_and_deal(pdf), schema)
        rows = cut(rows.join(crowded, same, "left_anti").unionByName(dealt))
    return rows.groupBy(*cell).applyInPandas(melt, schema)


def union_areas(parts: DataFrame, by: Sequence[str], uid: str, size: float) -> DataFrame:
    """by, n, area_sum, area_union: polygons of each group, the sum of their areas, and the area they cover together."""
    summed = parts.groupBy(*by, uid).agg(F.sum(area()).alias("area")).groupBy(*by).agg(F.count("*").alias("n"), F.sum("area").alias("area_sum"))
    covered = dissolved(parts, by, size).groupBy(*by).agg(F.sum(area()).alias("area_union"))
    right = covered.withColumnsRenamed({c: f"_{c}" for c in by})
    return summed.join(right, [summed[c].eqNullSafe(right[f"_{c}"]) for c in by], "left").select(*by, "n", "area_sum", F.coalesce("area_union", F.lit(0.0)).alias("area_union"))


def pixels(df: DataFrame, rings: str, keep: Sequence[str], size: float = 1.0, supersample: int = 1, touched: bool = False) -> DataFrame:
    """keep, px, py, hits: how many of a pixel's supersample**2 places lie within a polygon; pixels of side `size` are counted from the origin.

    Row by row of places, the edges' crossings in pairs bound the runs that are filled. touched: every pixel that shares some area counts, with
    hits 1, for polygons smaller than a pixel."""
    step = size / supersample

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                owner, a, b = edges(some.column("_rings"))
                if touched:
                    own, sides = decompose(owner, a, b)
                    row, px, py, _ = clip(sides, size)
                    who = own[row]
                    hits = np.ones(len(who), np.int64)
                else:
                    who, sx, sy = scan_rows(owner, a, b, step)
                    px, py, hits = sx // supersample, sy // supersample, np.ones(len(who), np.int64)
                order = np.lexsort((px, py, who))
                who, px, py, hits = who[order], px[order], py[order], hits[order]
                new = np.r_[True, (np.diff(who) != 0) | (np.diff(px) != 0) | (np.diff(py) != 0)][: len(who)]
                first = np.flatnonzero(new)
                total = np.add.reduceat(hits, first) if len(first) else hits
                total = np.ones_like(total) if touched else total
                columns = [some.column(c).take(pa.array(who[first])) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(px[first]), pa.array(py[first]), pa.array(total)], [*keep, "px", "py", "hits"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "px long", "py long", "hits long"])
    return df.select(*keep, F.col(rings).cast(RINGS).alias("_rings")).mapInArrow(fill, schema)


def scan_rows(owner: np.ndarray, a: np.ndarray, b: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, column, row) of the places (column + 1/2, row + 1/2) * step within each owner's edges."""
    up = a[:, 1] > b[:, 1]
    a, b = np.where(up[:, None], b, a), np.where(up[:, None], a, b)
    first, last = np.ceil(a[:, 1] / step - 0.5), np.ceil(b[:, 1] / step - 0.5)  # rows with a's height <= centre < b's height
    edge, nth = spread((last - first).astype(np.int64))
    row = first[edge].astype(np.int64) + nth
    share = ((row + 0.5) * step - a[edge, 1]) / (b[edge, 1] - a[edge, 1])
    x = a[edge, 0] + share * (b[edge, 0] - a[edge, 0])
    order = np.lexsort((x, row, owner[edge]))
    left, right = order[::2], order[1::2]
    begin, end = np.ceil(x[left] / step - 0.5).astype(np.int64), np.ceil(x[right] / step - 0.5).astype(np.int64)
    run, nth = spread(np.maximum(end - begin, 0))
    return owner[edge[left[run]]], begin[run] + nth, row[left[run]]


def zonal(hits: DataFrame, raster: DataFrame, by: Sequence[str], above: float) -> DataFrame:
    """by, n, mean, max, p90, above_pct of the valid (not null, not NaN) values of the pixels (px, py, value) that a polygon's `hits` name; a place counts as often as it was hit."""
    value = F.when(~F.isnan("value"), F.col("value"))
    met = hits.join(raster, ["px", "py"]).withColumn("value", value).where("value is not null")
    n = F.sum("hits")
    return met.groupBy(*by).agg(
        n.alias("n"), (F.sum(F.col("value") * F.col("hits")) / n).alias("mean"), F.max("value").alias("max"),
        F.expr("percentile(value, 0.9, hits)").alias("p90"), (100 * F.sum(F.when(F.col("value") > above, F.col("hits")).otherwise(0)) / n).alias("above_pct"),
    )


def class_fractions(hits: DataFrame, raster: DataFrame, by: Sequence[str], classes: dict[int, str], supersample: int) -> DataFrame:
    """by, n_px, nodata_frac, frac_{name} of every class, majority, majority_frac. raster: px, py, class; classes that are not above 0, and missing ones, are no data.

    Pixels outside the raster count nowhere; fractions are over valid places. The majority is the largest, the class given first on a tie."""
    met = hits.join(raster.select("px", "py", F.col("class").alias("_class")), ["px", "py"])
    of = lambda condition: F.sum(F.when(condition, F.col("hits")).otherwise(0))
    counts = met.groupBy(*by).agg(F.sum("hits").alias("_all"), of(F.col("_class") > 0).alias("_valid"), *[of(F.col("_class") == code).alias(f"_{name}") for code, name in classes.items()])
    frac = [F.when(F.col("_valid") > 0, F.col(f"_{name}") / F.col("_valid")).alias(f"frac_{name}") for name in classes.values()]
    best = F.greatest(*[F.struct(F.col(f"_{name}").alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(classes.values())])
    some = lambda c: F.when(F.col("_valid") > 0, c)
    return counts.select(
        *by, (F.col("_all") / supersample**2).alias("n_px"), (1 - F.col("_valid") / F.col("_all")).alias("nodata_frac"), *frac,
        some(best["name"]).alias("majority"), some(best["n"] / F.col("_valid")).alias("majority_frac"),
    )
