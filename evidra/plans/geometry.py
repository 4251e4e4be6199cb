"""Queries over polygons: quality of plans, dissolved areas, coverage of plots, and statistics of a raster. SQL counts unit cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import polygons as pg
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()

#: A document is a polygon of whole corners: a box without its upper right corner, every third with a hole; 500 in a row, rows overlap.
CELLS = """d as (select doc_id as uid, coalesce(source, '') as grp, doc_id // 5000 as block, doc_id // 10 as frame, (doc_id % 500) * 6 as x, doc_id // 500 * 4 as y, 8 + doc_id % 5 as w, 5 + n_chars % 3 as h, lang, n_chars from documents where doc_id is not null),
c as (select uid, grp, block, frame, x + i as cx, y + j as cy, x + i >= (frame * 10 % 500) * 6 + 60 or y + j >= (frame // 50) * 4 + 6 as beyond from d, (select unnest(range(12)) as i), (select unnest(range(7)) as j)
where i < w and j < h and not (i >= w - 3 and j >= h - 2) and not (uid % 3 = 0 and i between 1 and 2 and j = 1))"""
#: A page is a plot: a box without its upper right corner.
PLOTS = """p as (select page_id as plot, (page_id % 100) * 30 as x, page_id // 100 * 3 as y from pages where page_id is not null),
l as (select plot, x + i as cx, y + j as cy from p, (select unnest(range(20)) as i), (select unnest(range(6)) as j) where not (i >= 15 and j >= 4))"""


def div(c, n: int):
    return F.floor(c / n)


def ring(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def notched(x, y, w, h, dx: int, dy: int):
    """The ring of a box without a corner of dx by dy at its upper right."""
    return ring((x, y), (x + w, y), (x + w, y + h - dy), (x + w - dx, y + h - dy), (x + w - dx, y + h), (x, y + h))


def parcels(spark, sf_dir):
    k, n = F.col("doc_id"), F.col("n_chars")
    x, y = k % 500 * 6, div(k, 500) * 4
    hole = F.when(k % 3 == 0, F.array(ring((x + 1, y + 1), (x + 3, y + 1), (x + 3, y + 2), (x + 1, y + 2)))).otherwise(F.array().cast(pg.RINGS))
    rings = F.concat(F.array(notched(x, y, 8 + k % 5, 5 + n % 3, 3, 2)), hole)
    rows = table(spark, sf_dir, "documents").where(k.isNotNull())
    return rows.select(k.alias("uid"), F.coalesce("source", F.lit("")).alias("grp"), div(k, 5000).alias("block"), div(k, 10).alias("frame"), rings.alias("rings"))


def plots(spark, sf_dir):
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").where(k.isNotNull()).select(k.alias("plot"), F.array(notched(k % 100 * 30, div(k, 100) * 3, F.lit(20), F.lit(6), 5, 2)).alias("rings"))


@query(f"""with {CELLS},
o as (select a.uid as uid, b.uid as other, count(*) as n from c a join c b on a.cx = b.cx and a.cy = b.cy and a.uid < b.uid group by a.uid, b.uid having count(*) > 2),
s as (select uid, count(*) as n, count(*) filter (beyond) as beyond from c group by uid)
select 'OVERLAP' as issue, uid, other, cast(n as double) as area, cast(null as double) as pct from o
union all select 'OUTSIDE_FRAME', uid, null, cast(beyond as double), round(100.0 * beyond / n, 4) from s where beyond > 4""")
def q136_plan_quality(spark, sf_dir):
    parts = pg.pieces(parcels(spark, sf_dir), "rings", 8.0, ["uid", "frame"])
    frame = F.col("frame")
    x, y = frame * 10 % 500 * 6, div(frame, 50) * 4
    frames = parcels(spark, sf_dir).select("frame").distinct().select("frame", F.array(ring((x, y), (x + 60, y), (x + 60, y + 6), (x, y + 6))).alias("rings"))
    over = pg.overlaps(parts, "uid", 2.0).select(F.lit("OVERLAP").alias("issue"), F.col("uid_a").alias("uid"), F.col("uid_b").alias("other"), F.round("area", 6).alias("area"), F.lit(None).cast("double").alias("pct"))
    out = pg.outside(parts, "uid", pg.pieces(frames, "rings", 8.0, ["frame"]), ["frame"], 4.0)
    return over.unionByName(out.select(F.lit("OUTSIDE_FRAME").alias("issue"), "uid", F.lit(None).cast("long").alias("other"), F.round("outside", 6).alias("area"), F.round("outside_pct", 4).alias("pct")))


@query(f"""with {CELLS} select grp, block, count(distinct uid) as n, cast(count(*) as double) as area_sum, cast(count(distinct (cx, cy)) as double) as area_union from c group by grp, block""")
def q137_dissolved_areas(spark, sf_dir):
    parts = pg.pieces(parcels(spark, sf_dir), "rings", 64.0, ["uid", "grp", "block"])
    found = pg.union_areas(parts, ["grp", "block"], "uid", 64.0)
    return found.withColumns({"area_sum": F.round("area_sum", 6), "area_union": F.round("area_union", 6)})


@query(f"""with {CELLS}, {PLOTS},
a as (select plot, count(*) as whole from l group by plot),
m as (select plot, uid, count(*) as n from l join c using (cx, cy) group by plot, uid),
v as (select plot, least(1.0, sum(n) / max(whole)) as coverage from m join a using (plot) group by plot)
select plot, 2020 + n_chars % 2 as year, lang as state, round(sum(n / whole), 6) as share, round(max(coverage), 6) as coverage from m join a using (plot) join v using (plot) join d using (uid) group by all""")
def q138_plot_coverage(spark, sf_dir):
    states = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), (2020 + F.col("n_chars") % 2).alias("year"), F.col("lang").alias("state"))
    found = pg.coverage(pg.pieces(plots(spark, sf_dir), "rings", 16.0, ["plot"]), "plot", pg.pieces(parcels(spark, sf_dir), "rings", 16.0, ["uid"]), "uid", states, ["year"])
    return found.withColumns({"share": F.round("share", 6), "coverage": F.round("coverage", 6)})


@query("""with r as (select doc_id % 500 as px, doc_id // 500 as py, case when doc_id % 11 > 0 then n_chars % 101 end as value, [10, 20, 40, 0][1 + n_chars % 4] as class from documents where doc_id is not null),
z as (select page_id as zone, (page_id % 100) * 5 + 0.125 as x, page_id // 100 * 0.75 + 0.125 as y from pages where page_id is not null),
t as (select zone, value from z join r on px between floor(x) and ceil(x + 3.5) - 1 and py between floor(y) and ceil(y + 2.25) - 1 where value is not null),
a as (select zone, count(*) as n, round(avg(value), 6) as mean, cast(max(value) as double) as max, round(quantile_cont(value, 0.9), 6) as p90, round(100.0 * count(*) filter (value > 25) / count(*), 6) as above_pct from t group by zone),
s as (select zone, cast(floor(x * 2) as bigint) + i as sx, cast(floor(y * 2) as bigint) + j as sy, x, y from z, (select unnest(range(8)) as i), (select unnest(range(6)) as j)),
g as (select zone, class from s join r on px = sx // 2 and py = sy // 2 where (sx + 0.5) / 2 between x and x + 3.5 and (sy + 0.5) / 2 between y and y + 2.25 and not ((sx + 0.5) / 2 > x + 2.5 and (sy + 0.5) / 2 > y + 1.25)),
f as (select zone, count(*) as n, count(*) filter (class > 0) as v, count(*) filter (class = 10) as c10, count(*) filter (class = 20) as c20, count(*) filter (class = 40) as c40 from g group by zone)
select zone, a.n as n, mean, max, p90, above_pct, f.n / 4 as n_px, round(1 - v / f.n, 6) as nodata_frac, round(c10 / nullif(v, 0), 6) as frac_tree, round(c20 / nullif(v, 0), 6) as frac_shrub, round(c40 / nullif(v, 0), 6) as frac_crop,
  case when v > 0 then case when c10 >= c20 and c10 >= c40 then 'tree' when c20 >= c40 then 'shrub' else 'crop' end end as majority, round(greatest(c10, c20, c40) / nullif(v, 0), 6) as majority_frac from a full join f using (zone)""")
def q139_raster_statistics(spark, sf_dir):
    k, n = F.col("doc_id"), F.col("n_chars")
    value, code = F.when(k % 11 > 0, (n % 101).cast("double")), F.element_at(F.array(*map(F.lit, (10, 20, 40, 0))), (1 + n % 4).cast("int"))
    raster = table(spark, sf_dir, "documents").where(k.isNotNull()).select((k % 500).alias("px"), div(k, 500).alias("py"), value.alias("value"), code.alias("class"))
    p = F.col("page_id")
    x, y = p % 100 * 5 + F.lit(0.125), div(p, 100) * F.lit(0.75) + F.lit(0.125)
    box = ring((x, y), (x + 3.5, y), (x + 3.5, y + 2.25), (x, y + 2.25))
    zones = table(spark, sf_dir, "pages").where(p.isNotNull()).select(p.alias("zone"), F.array(box).alias("box"), F.array(notched(x, y, F.lit(3.5), F.lit(2.25), 1, 1)).alias("rings"))
    stats = pg.zonal(pg.pixels(zones, "box", ["zone"], touched=True), raster, ["zone"], 25)
    shares = pg.class_fractions(pg.pixels(zones, "rings", ["zone"], supersample=2), raster, ["zone"], {10: "tree", 20: "shrub", 40: "crop"}, 2)
    found = stats.join(shares, "zone", "full")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "p90", "above_pct", "nodata_frac", "frac_tree", "frac_shrub", "frac_crop", "majority_frac")})
