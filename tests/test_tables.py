"""Columns, subtotals, groups and records of tables against plain rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import tables


@pytest.mark.parametrize(
    ("cell", "kind"),
    [
        (None, "empty"), (" -- ", "empty"), ("nil", "empty"), ("1.02.50", "ha"), ("0 : 12 : 5", "ha"), ("3-45.5", "ha"), ("012.50", "ha"), ("1,23,456", "money"), ("5000/-", "money"), ("₹ 50", "money"), ("ரூ. 500", "money"), ("173/2A", "survey"),
        ("12/1,2 (part)", "survey"), ("2.471", "dec"), ("1740000.00", "bignum"), ("12.", "int"), ("௧௨", "int"), ("4A1", "subdiv"), ("1, 2B", "subdiv"), ("Raman", "text"), ("முத்து", "text"), ("a1", "other"), ("6-ல் 1 பங்கில் (1/6)", "share"), ("1/6 share", "share"),
    ],
)
def test_cell_types(spark, cell, kind):
    assert spark.createDataFrame([(cell,)], "t string").select(tables.cell_type(F.col("t"))).first()[0] == kind


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many ranges as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def plain_totals(rows):
    """Numbers of the total rows of one table: (value, keyed) from the top."""
    out, run, n, kept = [], 0.0, 0, False
    for i, (v, keyed) in enumerate(rows):
        if v is not None and kept and not keyed and abs(v - run) < tables.SAME and (n >= 2 or i == len(rows) - 1):
            out.append(i)
            run, n = 0.0, 0
            continue
        run, n, kept = run + (v or 0.0), n + 1, True
    return out


def test_subtotals_reset_and_cross_tasks(spark, many_ranges):
    """Planted totals, near misses, rows whose key is lost; one table is much longer than a range of rows."""
    rng = random.Random(2)
    made, want = [], set()
    for name, size in [("a", 3000), *((f"t{i}", rng.randrange(1, 9)) for i in range(60)), (None, 40)]:
        rows, run = [], 0.0
        for _ in range(size):
            if rng.random() < 0.25:
                off, keyed = rng.choice([0, 0, 0, 0, 0.001, 1]), rng.random() < 0.1
                v = round(run + off, 4)
                run = round(run + v, 4) if off or keyed else 0.0
            else:
                v, keyed = rng.choice([None, 0.0, round(rng.random() * 3, 4)]), rng.random() < 0.9
                run = round(run + (v or 0), 4)
            rows.append((v, keyed))
        want |= {(name, i) for i in plain_totals(rows)}
        made += [(name, i, v, k, "x") for i, (v, k) in enumerate(rows)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "t string, row int, v double, keyed boolean, is_it string").repartition(5)
    out = tables.subtotals(df, ["t"], "row", F.col("v"), F.col("keyed"))
    assert out.count() == len(made) and {(r["t"], r["row"]) for r in out.where("is_total").collect()} == want and len(want) > 50
    assert tables.subtotals(df.limit(0), ["t"], "row", F.col("v"), F.col("keyed")).count() == 0


def test_heads_cross_ranges(spark, many_ranges):
    rng = random.Random(4)
    made, want = [], {}
    for name, size, share in (("a", 4000, 0.001), ("b", 5, 0.0), ("c", 3000, 0.3), (None, 50, 0.2)):
        head = None
        for i in range(size):
            start = rng.random() < share
            head = i if start else head
            want[name, i] = head
            made.append((name, i, start))
    df = spark.createDataFrame(rng.sample(made, len(made)), "t string, row int, s boolean")
    got = {(r["t"], r["row"]): r["head"] for r in tables.heads(df, ["t"], "row", F.col("s")).collect()}
    assert got == want
    assert tables.heads(df.limit(0), ["t"], "row", F.col("s")).count() == 0


def cells_of(tables_):
    return [(t, r, c, x) for t, rows in tables_.items() for r, row in enumerate(rows) for c, x in enumerate(row)]


def test_records_of_small_tables(spark):
    shown = {
        "d": [["1", "101/2A", "Raman", "", "1,00,000"], ["", "", "Sita", "0.50.00", "2,00,000"], ["", "", "Mani", "", ""], ["", "", "", "", "3,00,000"], ["", "", "", "0.50.00", ""], ["2", "102", "Devi", "1.00.00", "-"], ["", "", "Total", "1.50.00", "6,00,000"]],
        "e": [["7/1", "0.10.00"], ["7/2", "0.20.00"], ["", "0.30.00"], ["8/1", "0.40.00"], [None, "0.40.00"]],
    }
    labels = [("d", 0, "S. No"), ("d", 1, "Survey No"), ("d", 2, "Name of the owner"), ("d", 3, "Extent (Hect.)"), ("d", 4, ""), ("e", 0, None)]
    cells = spark.createDataFrame(cells_of(shown), "t string, row int, col int, text string").repartition(3)
    records, totals = tables.parcel_records(cells, spark.createDataFrame(labels, "t string, col int, label string"), ["t"])
    got = sorted((r["t"], r["row"], r["serial"], r["survey_no"], r["owner"], r["extent_ha"], r["amount_rs"], r["group_row"], r["filled"], r["moved"]) for r in records.collect())
    assert got == [
        ("d", 0, "1", "101/2A", "Raman", 0.5, 100000, 0, False, True), ("d", 1, None, "101/2A", "Sita", None, 200000, 0, True, False), ("d", 2, None, "101/2A", "Mani", None, 300000, 0, True, False), ("d", 5, "2", "102", "Devi", 1.0, None, 5, False, False),
        ("e", 0, None, "7/1", None, 0.1, None, 0, False, False), ("e", 1, None, "7/2", None, 0.2, None, 1, False, False), ("e", 3, None, "8/1", None, 0.4, None, 3, False, False),
    ]
    assert sorted((r["t"], r["row"], r["kind"], r["extent_ha"], r["amount_rs"]) for r in totals.collect()) == [("d", 4, "unlabelled", 0.5, None), ("d", 6, "labelled", 1.5, 600000), ("e", 2, "unlabelled", 0.3, None), ("e", 4, "unlabelled", 0.4, None)]
    none, no_totals = tables.parcel_records(cells.limit(0), spark.createDataFrame([], "t string, col int, label string"), ["t"])
    assert none.count() == 0 and no_totals.count() == 0


def test_fields_by_label_then_content(spark):
    cells = spark.createDataFrame([("a", 0, 0, "Raman"), ("a", 1, 0, "Sita"), ("a", 0, 1, "12"), ("a", 0, 2, "5,000"), ("a", 0, 3, "4,000"), ("a", 0, 4, "0.10.00"), ("a", 1, 4, "x y z"), ("a", 0, 5, ""), ("a", 0, 6, "Kumar")], "t string, row int, col int, text string")
    labels = spark.createDataFrame([("a", 0, "Village"), ("a", 1, "Survey"), ("a", 3, "Amount"), ("a", 5, "Share"), ("a", 6, "Owner")], "t string, col int, label string")
    got = {r["col"]: (r["field"], r["how"], r["type"], r["type_share"]) for r in tables.column_fields(cells, labels, ["t"]).collect()}
    assert got == {1: ("survey_no", "label", "int", 1.0), 3: ("amount_rs", "label", "money", 1.0), 4: ("extent_ha", "content", "ha", 0.5), 6: ("owner", "label", "text", 1.0)}
