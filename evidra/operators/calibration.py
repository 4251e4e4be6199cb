"""Isotonic calibration: a rising step fit of truths on scores, and probabilities that follow it.

Neighbouring blocks whose means fall are pooled until means rise. Pooling can be done in any order, so it is done where the rows are first: scores are dealt to tasks in
ranges, equal scores are one block with their sums, each batch pools its own blocks, and what is left (few blocks) is gone through once a group, in order; only blocks that
may still be pooled are held. A score between two blocks lies on the line between them, a score beyond all on the level of the last. Rows meet their block by an equi-join on
cells of the score range, so neither side is gathered or broadcast.

Edge cases: rows with a null or non-finite score or truth teach nothing, and such a score has no level; weights that are null or not above 0 teach nothing either; a group is told
apart with null as a value of its own; one without blocks gives null levels; an empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut

#: Cells of a group's score range by which rows and blocks meet.
CELLS = 4096
BLOCK = ("low", "high", "sum", "weight")


def pool(blocks: list[list], block: list) -> None:
    """Adds a block (low, high, sum, weight) on top of rising ones and pools as long as the last two don't rise."""
    while blocks and blocks[-1][2] * block[3] >= block[2] * blocks[-1][3]:
        low, _, total, weight = blocks.pop()
        block = [low, block[1], total + block[2], weight + block[3]]
    blocks.append(block)


def pooled(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    """Blocks (_group, BLOCK) in order, pooled within each batch, or within each group."""
    group, blocks = None, []
    for batch in batches:
        out = []
        for key, *block in zip(batch["_group"], *(batch[c] for c in BLOCK), strict=True):
            if key != group:
                out += [(group, *b) for b in blocks]
                group, blocks = key, []
            pool(blocks, block)
        if not whole:
            out += [(group, *b) for b in blocks]
            blocks = []
        yield pd.DataFrame(out, columns=["_group", *BLOCK])
    if blocks:
        yield pd.DataFrame([(group, *b) for b in blocks], columns=["_group", *BLOCK])


def key_of(group: Sequence[str]) -> Column:
    return F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def isotonic(rows: DataFrame, group: Sequence[str], score: str, truth: str, weight: str | None = None) -> DataFrame:
    """_group (the group's key as text), low, high (scores of a block), level, weight, next_low, next_level of every block."""
    w = finite(F.col(weight).cast("double")) if weight else F.lit(1.0)
    known = rows.select(key_of(group).alias("_group"), finite(F.col(score).cast("double")).alias("low"), finite(F.col(truth).cast("double")).alias("y"), w.alias("weight"))
    known = known.where("low is not null and y is not null and weight > 0").groupBy("_group", "low").agg(F.sum(F.col("y") * F.col("weight")).alias("sum"), F.sum("weight").alias("weight"))
    schema = "_group string, low double, high double, sum double, weight double"
    first = known.select("_group", "low", F.col("low").alias("high"), "sum", "weight").repartitionByRange("_group", "low").sortWithinPartitions("_group", "low")
    few = first.mapInPandas(lambda batches: pooled(batches, False), schema)
    blocks = few.repartition("_group").sortWithinPartitions("_group", "low").mapInPandas(lambda batches: pooled(batches, True), schema)
    order = Window.partitionBy("_group").orderBy("low")
    level = F.col("sum") / F.col("weight")
    fitted = blocks.select("_group", "low", "high", level.alias("level"), "weight")
    return cut(fitted.withColumns({"next_low": F.lead("low").over(order), "next_level": F.lead("level").over(order)}))


def calibrated(rows: DataFrame, group: Sequence[str], score: str, blocks: DataFrame, name: str = "level") -> DataFrame:
    """rows and the level of their score by the blocks of isotonic()."""
    ends = blocks.groupBy("_group").agg(F.min("low").alias("_least"), F.max("high").alias("_most"))
    cell = lambda x: F.when(F.col("_most") > F.col("_least"), F.floor((x - F.col("_least")) / (F.col("_most") - F.col("_least")) * CELLS)).otherwise(F.lit(0)).cast("int")
    reach = F.coalesce("next_low", "high")
    steps = blocks.join(ends, "_group").withColumn("_cell", F.explode(F.sequence(cell(F.col("low")), cell(reach))))
    steps = steps.select("_group", "_cell", "low", "high", "level", "next_low", "next_level").withColumnsRenamed({c: f"_{c}" for c in ("low", "high", "level", "next_low", "next_level")})
    x = finite(F.col(score).cast("double"))
    asked = rows.withColumn("_group", key_of(group)).join(ends, "_group", "left").withColumn("_x", F.least(F.greatest(x, F.col("_least")), F.col("_most")))
    asked = asked.withColumn("_x", F.when(x.isNotNull(), F.col("_x"))).withColumn("_cell", cell(F.col("_x")))
    rise = F.col("_level") + (F.col("_next_level") - F.col("_level")) * (F.col("_x") - F.col("_high")) / (F.col("_next_low") - F.col("_high"))
    level = F.when(F.col("_x") <= F.col("_high"), F.col("_level")).otherwise(rise)
    on = (asked["_group"] == steps["_group"]) & (asked["_cell"] == steps["_cell"]) & (F.col("_x") >= F.col("_low")) & ((F.col("_x") < F.col("_next_low")) | F.col("_next_low").isNull())
    return asked.join(steps, on, "left").select(*[asked[c] for c in rows.columns], level.alias(name))


def calibrated_classes(rows: DataFrame, item: Sequence[str], kind: str, p: str, truth: str, learned: DataFrame | None = None) -> DataFrame:
    """rows and p_calibrated: each class's probability by its own isotonic fit, then made to sum to 1 within an item.

    rows: one a (item, class) with probability and truth (0 or 1; null: not known). A class whose truths are all alike keeps its probabilities; an item whose
    calibrated ones are all 0 keeps its own. learned: rows to fit on, where they are others."""
    known = learned if learned is not None else rows
    mixed = known.where(F.col(truth).isNotNull()).groupBy(kind).agg(F.min(truth).alias("_a"), F.max(truth).alias("_b")).where("_a < _b").select(kind)
    blocks = isotonic(known.join(mixed, kind, "left_semi"), [kind], p, truth)
    fitted = calibrated(rows, [kind], p, blocks, "_p").withColumn("_p", F.coalesce("_p", F.col(p).cast("double")))
    total = fitted.groupBy(*item).agg(F.sum("_p").alias("_total"))
    out = fitted.join(total, list(item))
    return out.withColumn("p_calibrated", F.when(F.col("_total") > 0, F.col("_p") / F.col("_total")).otherwise(F.col(p).cast("double"))).drop("_p", "_total")
