"""Owners of a cell by tokens: titles, relations, heirs, numbers, and texts of any length."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from evidra.functions import names


def test_owner_by_tokens(spark):
    cases = {
        "(2) Thiru Dr. Muthu, d / o Sri Kannan legal heirs": ("Muthu", "father", "Kannan", "Thiru", True),
        "திருமதி லட்சுமி க/பெ. ராமன்": ("லட்சுமி", "husband", "ராமன்", "திருமதி", False),
        "Raman மகன் Thiru Muthu S/o Velan": ("Muthu S/o Velan", "father", "Raman", None, False),
        "Smts/o Kannan": ("", "father", "Kannan", "Smt", False),
        "மகன் முத்து": ("", "father", "முத்து", None, False),
        "wife  of Raman": ("", "husband", "Raman", None, False),
        "A. K. Chandra": ("A. K. Chandra", None, None, None, False),
        "legal heirs": ("", None, None, None, True),
        " .;": ("", None, None, None, False),
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None, "", "  "]], "t string").coalesce(1)
    got = {r["t"]: r["o"] for r in df.select("t", names.owner(F.col("t")).alias("o")).collect()}
    for text, want in cases.items():
        o = got[text]
        assert (o["name"], o["relation"], o["relation_name"], o["honorific"], o["legal_heirs"]) == want, text
    assert got[None] is None and got[""] is None and got["  "] is None and got["A. K. Chandra"]["key"] == "a k chandra"


def test_owners_of_a_cell(spark):
    cases = {
        "1) A\nS/o B 2) C": ["A S/o B", "C"], "A\nand B\n(minor)\nC": ["A and B (minor)", "C"], "1. A; 2. B;; 12": ["A", "B"], "A\n \nB": ["A", "B"], "Plot 12.5 A": ["Plot 12.5 A"],
        "1. A 2. B": ["A", "B"], "A\x01B": ["A B"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").coalesce(1)
    assert {r["t"]: r["o"] for r in df.select("t", names.split_owners(F.col("t")).alias("o")).collect()} == cases


def test_long_cells_take_linear_time(spark):
    df = spark.createDataFrame([("Muthu S/o Raman " + "x y. 1. " * 25_000,)], "t string").coalesce(1)
    began = time.perf_counter()
    (row,) = df.select(names.owner(F.col("t")).alias("o"), F.size(names.split_owners(F.col("t"))).alias("n"), F.length(names.latin_key(F.col("t"))).alias("k")).collect()
    assert row["o"]["name"] == "Muthu" and row["n"] > 20_000 and row["k"] > 0 and time.perf_counter() - began < 60
