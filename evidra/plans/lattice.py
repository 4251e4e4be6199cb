"""Control cells in rings around places of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import lattice
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()
SIZE, INNER, OUTER, BUFFER = 80, 160, 480, 30
CLASSES = ("crop", "grass", "tree")

RINGS = """docs as (select doc_id, doc_id % 40 * 900 as x, doc_id // 40 * 700 as y, n_chars % 300 as w from documents where n_chars is not null),
core as (select distinct x as x0, y as y0, x + w as x1, y + w // 2 as y1 from docs),
water as (select distinct x - 350 as x0, y as y0, x - 200 as x1, y + 20 as y1 from docs where doc_id % 7 = 3),
columns as (select *, unnest(range((x0 - 480) // 80 - 1, (x1 + 480) // 80 + 2)) as ix from core),
pairs as (select *, unnest(range((y0 - 480) // 80 - 1, (y1 + 480) // 80 + 2)) as iy from columns),
apart as (select ix, iy, min(greatest(0, x0 - ix * 80 - 80, ix * 80 - x1) ** 2 + greatest(0, y0 - iy * 80 - 80, iy * 80 - y1) ** 2) as near, min(greatest(0, x0 - ix * 80 - 40, ix * 80 + 40 - x1) ** 2 + greatest(0, y0 - iy * 80 - 40, iy * 80 + 40 - y1) ** 2) as centre,
min(greatest(0, x0 - ix * 80, ix * 80 - x1) ** 2 + greatest(0, y0 - iy * 80, iy * 80 - y1) ** 2) as a, min(greatest(0, x0 - ix * 80, ix * 80 - x1) ** 2 + greatest(0, y0 - iy * 80 - 80, iy * 80 + 80 - y1) ** 2) as b,
min(greatest(0, x0 - ix * 80 - 80, ix * 80 + 80 - x1) ** 2 + greatest(0, y0 - iy * 80, iy * 80 - y1) ** 2) as c, min(greatest(0, x0 - ix * 80 - 80, ix * 80 + 80 - x1) ** 2 + greatest(0, y0 - iy * 80 - 80, iy * 80 + 80 - y1) ** 2) as d from pairs group by ix, iy),
ring as (select ix, iy, sqrt(centre) as distance from apart where near >= 160 ** 2 and greatest(a, b, c, d) <= 480 ** 2),
spots as (select doc_id, x, y, w, unnest(range(0, 40)) as k from docs),
pixels as (select cast(floor((x + w + k * 263 % 1000 - 500) / 80) as bigint) as ix, cast(floor((y + w + k * 449 % 1000 - 500) / 80) as bigint) as iy, case (doc_id * 7 + k) % 23 when 0 then 'tree' when 1 then 'grass' else 'crop' end as class from spots where (doc_id + k) % 31 <> 5),
counted as (select ix, iy, count(*) as valid, count(*) filter (class = 'crop') / count(*) as crop, count(*) filter (class = 'tree') / count(*) as tree from pixels group by ix, iy),
wet as (select distinct ix, iy from ring join water on greatest(0, x0 - ix * 80 - 80, ix * 80 - x1) ** 2 + greatest(0, y0 - iy * 80 - 80, iy * 80 - y1) ** 2 <= 900),
fit as (select ring.*, valid, crop from ring join counted using (ix, iy) anti join wet using (ix, iy) where crop >= 0.8 and tree = 0)"""


def places(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars is not null")
    return docs.select("doc_id", (F.col("doc_id") % 40 * 900).alias("x"), (F.floor(F.col("doc_id") / 40) * 700).alias("y"), (F.col("n_chars") % 300).alias("w"))


def fit_cells(spark, sf_dir):
    """The core, and the cells around it that are crops to four fifths and clear of trees and water."""
    docs = places(spark, sf_dir)
    core = docs.selectExpr("x as x0", "y as y0", "x + w as x1", "y + floor(w / 2) as y1")
    water = docs.where("doc_id % 7 = 3").selectExpr("x - 350 as x0", "y as y0", "x - 200 as x1", "y + 20 as y1")
    spots = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).where("(doc_id + k) % 31 <> 5")
    kind = F.expr("case (doc_id * 7 + k) % 23 when 0 then 'tree' when 1 then 'grass' else 'crop' end")
    pixels = spots.select(F.expr("x + w + k * 263 % 1000 - 500").alias("x"), F.expr("y + w + k * 449 % 1000 - 500").alias("y"), kind.alias("class"))
    shares = lattice.class_shares(lattice.ring_cells(core, SIZE, INNER, OUTER), pixels, CLASSES, SIZE)
    return core, lattice.without(shares.where("share_crop >= 0.8 and share_tree = 0"), water, SIZE, BUFFER)


@query(f"with {RINGS} select ix, iy, round(distance, 6) as distance, valid, round(crop, 6) as crop from fit")
def q152_fit_cells(spark, sf_dir):
    _, fit = fit_cells(spark, sf_dir)
    return fit.select("ix", "iy", F.round("distance", 6).alias("distance"), "valid", F.round("share_crop", 6).alias("crop"))


@query(f"""with {RINGS}, thin as (select ix, iy, md5(concat(ix, '_', iy, '|7')) as r from fit qualify row_number() over (partition by floor(ix * 80 / 500), floor(iy * 80 / 500) order by md5(concat(ix, '_', iy, '|7'))) = 1),
middle as (select sum((x0 + x1) * (x1 - x0) * (y1 - y0)) / sum((x1 - x0) * (y1 - y0)) / 2 as mx, sum((y0 + y1) * (x1 - x0) * (y1 - y0)) / sum((x1 - x0) * (y1 - y0)) / 2 as my from (select x as x0, y as y0, x + w as x1, y + w // 2 as y1 from docs)),
turned as (select thin.*, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][1 + cast(floor(((degrees(atan2(ix * 80 + 40 - mx, iy * 80 + 40 - my)) + 360) % 360 + 22.5) / 45) as int) % 8] as sector from thin, middle),
shares as (select sector, greatest(1, round_even(500 * count(*) / sum(count(*)) over (), 0)) as quota from turned group by sector),
placed as (select *, row_number() over (partition by sector order by r) as place from turned join shares using (sector))
select sector, ix, iy from placed where place <= quota order by sector, ix, iy limit 500""")
def q153_control_cells(spark, sf_dir):
    core, fit = fit_cells(spark, sf_dir)
    thin = lattice.thinned(fit.select("ix", "iy"), SIZE, 500, 7)
    return lattice.by_sector(lattice.in_sectors(thin, core, SIZE), 500, 7).select("sector", "ix", "iy")
