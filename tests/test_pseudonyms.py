"""Pseudonyms against a plain account of their rules, exact ways back, and what is left raw."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.operators import pseudonyms as ps

TEXTS = "k int, text string, src string"


def shown(spark, rows, names=(), **more):
    df = spark.createDataFrame(rows, TEXTS)
    known = spark.createDataFrame([(n,) for n in names], "name string") if names else None
    public, mapping = ps.pseudonymise(df, "k", ["text"], names=known, **more)
    return public, mapping


def test_names_markers_and_amounts(spark):
    rows = [
        (1, "Thiru. Karuppasamy S/o Veerabhadran; நில உரிமையாளர்: ஆறுமுகம் த/பெ கணேசன்", "a"), (2, "KARUPPASAMY got Rs.12,60,000/- and Ann Leeds got INR 50", "a"), (3, "Annabel, Ann and ann Leeds; see ⟨OWNER_1⟩ S/o ⟨OWNER_2⟩", "a"),
        (4, None, "a"), (5, "", None), (2, "KARUPPASAMY got Rs.12,60,000/- and Ann Leeds got INR 50", "a"), (None, "x Ann", None),
    ]
    public, mapping = shown(spark, rows, ["Ann", "Ann Leeds", "karuppasamy"], scope="src")
    got = {(r["k"], r["text"]) for r in public.collect()}
    assert got == {
        (1, "Thiru. ⟨OWNER_1⟩ S/o ⟨OWNER_2⟩; நில உரிமையாளர்: ⟨OWNER_3⟩ த/பெ ⟨OWNER_4⟩"), (2, "⟨OWNER_1⟩ got ⟨AMT_1⟩ and ⟨OWNER_5⟩ got ⟨AMT_2⟩"), (3, "Annabel, ⟨OWNER_6⟩ and ⟨OWNER_5⟩; see ⟨OWNER_1⟩ S/o ⟨OWNER_2⟩"),
        (4, None), (5, ""), (None, "x ⟨OWNER_1⟩"),
    }
    assert public.count() == len(rows)
    values = {(r["scope"], r["token"]): r["value"] for r in mapping.collect()}
    assert values[("a", "⟨OWNER_1⟩")] == "karuppasamy" and values[("a", "⟨AMT_1⟩")] == "Rs.12,60,000/-" and values[(None, "⟨OWNER_1⟩")] == "Ann" and len(values) == 9
    back = ps.restore(public, ["text"])
    assert back.columns == ["k", "text", "src"] and sorted(map(repr, back.collect())) == sorted(map(repr, spark.createDataFrame(rows, TEXTS).collect()))
    reply = spark.createDataFrame([(1, "⟨OWNER_5⟩ pays ⟨AMT_1⟩⟨AMT_2⟩, not ⟨OWNER_99⟩", "a"), (2, "⟨OWNER_1⟩", None), (3, None, "a"), (4, "none", "b"), (5, "⟨OWNER_1⟩", "b")], TEXTS)
    assert [r["text"] for r in ps.reinsert(reply, "text", mapping, "src").orderBy("k").collect()] == ["Ann Leeds pays Rs.12,60,000/-INR 50, not ⟨OWNER_99⟩", "Ann", None, "none", "⟨OWNER_1⟩"]


def test_fields_facts_and_clashing_columns(spark):
    rows = [(1, "owner", "Ravi K", " Mala ", 1200.5, "x"), (2, "village", "saw Ravi here", "⟨OWNER_7⟩", None, "y"), (3, "amount_rs", "Ravi", "  ", 1200.5, "z"), (4, "OWNER", "ravi k", None, 7.0, None)]
    df = spark.createDataFrame(rows, "k int, fact_type string, value_text string, owner string, amount double, texts string")
    kinds = {**ps.field_kinds(df.columns), "value_text": ps.fact_kinds(F.col("fact_type"))}
    known = spark.createDataFrame([("Ravi",)], "name string")
    public, mapping = ps.pseudonymise(df, "k", ["value_text", "owner", "amount"], names=known, kinds=kinds, private="hits")
    got = [tuple(r)[:6] for r in public.orderBy("k").collect()]
    assert got == [
        (1, "owner", "⟨OWNER_1⟩", "⟨OWNER_2⟩", "⟨AMT_1⟩", "x"), (2, "village", "saw ⟨OWNER_3⟩ here", "⟨OWNER_7⟩", None, "y"), (3, "amount_rs", "⟨AMT_2⟩", "  ", "⟨AMT_1⟩", "z"), (4, "OWNER", "⟨OWNER_1⟩", None, "⟨AMT_3⟩", None),
    ]
    assert {r["value"] for r in mapping.collect()} == {"Ravi K", "Mala", "1200.5", "Ravi", "7.0"}
    assert [r["owner"] for r in ps.restore(public, ["value_text", "owner", "amount"], "hits").orderBy("k").collect()] == [" Mala ", "⟨OWNER_7⟩", "  ", None]


def test_equal_fields_of_other_kinds_stay_apart(spark):
    df = spark.createDataFrame([(1, "owner", "Ravi"), (1, "village", "Ravi")], "k int, fact_type string, v string")
    public, _ = ps.pseudonymise(df, "k", ["v"], kinds={"v": ps.fact_kinds(F.col("fact_type"))})
    assert {tuple(r)[1:3] for r in public.collect()} == {("owner", "⟨OWNER_1⟩"), ("village", "Ravi")}


def test_blocks_of_names_find_the_same(spark, monkeypatch):
    names = [f"name{chr(97 + i)}{'x' * (i % 5)}" for i in range(24)] + ["namea namebx", "பெயர்"]
    rows = [(i, f"{a} {b}, {a.upper()}{b} பெயர்கள்", "a") for i, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    whole = sorted(map(repr, shown(spark, rows, names)[0].collect()))
    monkeypatch.setattr(ps, "NAME_BYTES", 60)
    public, _ = shown(spark, rows, names)
    assert sorted(map(repr, public.collect())) == whole
    left = {r["name"]: r["n_rows"] for r in ps.residual(public, ["text"], spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    low = [r["text"].lower() for r in public.collect()]
    assert left == {n: c for n in names if (c := sum(n in t for t in low))}


def test_numbers_are_dense_in_the_order_first_seen(spark):
    rows = [(i, f"v{i * 7919 % 501}", "s" if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, value string, scope string").select(F.coalesce("scope", F.lit("")).alias("scope"), F.lit("OWNER").alias("kind"), "value", F.struct("i").alias("at"))
    want: dict = {}
    for i, v, s in rows:
        scoped = want.setdefault(s or "", {})
        scoped.setdefault(v, f"⟨OWNER_{len(scoped) + 1}⟩")
    assert {(r["scope"], r["value"]): r["token"] for r in ps.number(df).collect()} == {(s, v): t for s, m in want.items() for v, t in m.items()}


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "Ann Leeds, " * 60000 + "S/o Bo", "a")]
    public, mapping = shown(spark, rows, ["Ann Leeds"])
    row = public.first()
    assert row["text"] == "⟨OWNER_1⟩, " * 60000 + "S/o Bo" and mapping.count() == 1 and len(row["private"]) == 60000
    assert ps.restore(public, ["text"]).first()["text"] == rows[0][1] and ps.reinsert(public, "text", mapping).first()["text"] == rows[0][1]
    none = spark.createDataFrame([], TEXTS)
    public, mapping = ps.pseudonymise(none, "k", ["text"])
    assert public.count() == mapping.count() == ps.reinsert(none, "text", mapping).count() == ps.residual(none, ["text"], mapping.select("value")).count() == 0


NAME = st.one_of(st.text(alphabet=[c for c in map(chr, range(0x0B85, 0x0BB9)) if c.isalpha()], min_size=4, max_size=10), st.from_regex(r"[A-Z][a-z]{3,9}", fullmatch=True))


@settings(max_examples=200, deadline=None)
@given(names=st.lists(NAME, min_size=1, max_size=4), text=st.text(alphabet="Ab cS/o.Rs12⟨⟩", max_size=20), data=st.data())
def test_spans_leave_no_name_and_turn_back(names, text, data):
    parts = [data.draw(st.sampled_from([*names, " ", "; ", text, "S/o ", " மனைவி "])) for _ in range(8)]
    whole = " ".join(parts)
    machine = ps._machine(sorted(set(names)))
    spans = ps._spans(whole, list(ps._known(machine, whole)), True)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    hits = [{"start": s, "end": e, "token": f"⟨{k}_1⟩"} for s, e, k, _ in spans]
    out, private = ps._swap(whole, hits)
    assert ps._swap(out, [{"start": s, "end": e, "token": raw} for s, e, raw in private])[0] == whole
    bare = re.sub(ps.TOKEN, "⟨⟩", out)
    for n in names:
        form = rf"(?<![A-Za-z]){n}(?![A-Za-z])" if n.isascii() else n
        assert not re.search(form, bare)


@pytest.mark.parametrize(
    ("owner", "note", "declared", "tier", "n"),
    [("⟨OWNER_1⟩", "S/o ⟨OWNER_2⟩", "pseudo ", "PSEUDO", 0), ("Ravi", "x", "PUBLIC", "PII", 1), (None, "W/o Malar", "PSEUDO", "PII", 1), (" ", "", "PUBLIC", "PUBLIC", 0), (None, None, None, "PII", 1), ("Ravi", "S/o Bala", "secret", "PII", 1), ("", "S/o Bo", "PUBLIC", "PUBLIC", 0)],
)
def test_tiers(spark, owner, note, declared, tier, n):
    row = spark.createDataFrame([(owner, note, declared)], "owner string, note string, tier string").select(ps.effective_tier(F.col("tier"), ["owner", "note"]).alias("t")).first()["t"]
    assert (row["tier"], len(row["notes"])) == (tier, n)


def test_clean_names(spark):
    rows = [("முருகன்",), ("இழப்பீட்டுத் தொகை",), ("கள்",), ("100% x",), ("Total Due",), ("a b c d e f",), (" Mala Devi ",), (None,), ("Mala Devi",)]
    got = ps.clean_names(spark.createDataFrame(rows, "n string"), F.col("n"), ["தொகை", "Total"]).collect()
    assert sorted(r["name"] for r in got) == sorted(["முருகன்", "Mala Devi"])
