"""The audit of filters against SQL, and against applying every order by hand."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import functions as F

from evidra.llm import op12_audit as op
from oracle import both


def test_audit_matches_sql(spark, sf_dir):
    got, want = both(spark, sf_dir, op.op12_filter_audit, op.ORACLE)
    assert got == want and len(got) % 600 == 0 and len(got) > 0


def fails(rows):
    """Sets of failed filters, by plain Python."""
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        out.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        })
    return out


def test_audit_by_hand(spark, docs, empty):
    long_ = " ".join(f"w{i}" for i in range(60))
    more = [(20 + i, long_ + " &" * (i % 3 == 0) + " A" * (i % 4 * 7), None, "s1" if i % 2 else "s9", 0, 0.5, "p", "n") for i in range(12)] + [(40, long_, None, "s1", 0, 0.5, "p", "n")] * 3 + [(41, long_, None, "s9", 0, 0.5, "p", "n")]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (20, 1, 1), (23, 0, 0), (26, 1, 1), (41, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in op.audit(op.text_checks(df, marks), F.col("part"), {f: F.col(f.lower()) for f in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")}).collect()}

    rows = [(r["doc_id"], r["text"], r["source"] or "") for r in df.collect()]
    good, toxic = {1, 2, 20, 26}, {2, 20, 26, 41}
    every = list(zip(rows, fails(rows), strict=True))
    parts = {r[2] for r in rows}
    assert len(got) == 600 * len(parts)
    shapley = dict.fromkeys([(p, f) for p in parts for f in "ABCDE"], 0)
    for order in permutations("ABCDE"):
        for part in parts:
            left = [x for x in every if x[0][2] == part]
            gone = []
            for k, f in enumerate(order):
                out = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                r = got[part, "".join(order), k + 1]
                own = [x for x in every if x[0][2] == part]
                want = (len(left), len(out), sum(x[1][f] for x in gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[0][0] in good for x in out), sum(x[0][0] in toxic for x in out))
                assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want
                gone += out
                shapley[part, f] += len(out)
    assert all(r["shapley"] == shapley[p, o[k - 1]] for (p, o, k), r in got.items())
    assert op.audit(op.text_checks(empty, marks), F.col("part"), {"A": F.col("a")}, {}).count() == 0


def test_states_are_shared_and_given_up(spark):
    df = spark.range(100).select(F.lit("p").alias("part"), *[(F.col("id") % (i + 2) == 0).alias(f"f_{f}") for i, f in enumerate("xyz")])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    edges = {(r["state"], r["filter"]): (r["kept"], r["removed"]) for r in op.walk(df, list("xyz"), []).collect()}
    assert len(edges) == 3 * 4 and edges["", "y"] == (66, 34) and edges["xz", "y"] == (33, 17) and edges["x", "z"] == (50, 0)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
