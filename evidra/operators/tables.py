"""Records from transcribed tables: typed columns, fields of columns, subtotals, wrapped rows and groups of rows.

Tables come as long rows: cells (table, row, col, text) and labels (table, col, label). Column types are votes of their cells, summed in each task.
What depends on the rows above (a running sum that starts again after each total, the head of a group) is worked out over rows that are sorted by
table and row in ranges: each task goes through its range batch by batch and holds one table's state at a time. A table that reaches over several ranges costs no task more
than its own range: ranges leave sums or last heads behind, a few numbers each, that the next step takes up.

Edge cases: null cells are empty; tables are told apart with nulls as values of their own; rows that repeat a row number of a table make one row with the smallest text of each
field; columns without a label or a filled cell have no field; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import normalise
from evidra.sources.checkpoints import cut

#: What an empty cell may hold, and words of totals and of shares.
EMPTY = ("", "-", "--", "---", "—", "–", "nil", "null", "none", "...")
TOTAL = r"(?i)மொத்தம்|மொத்த\s*$|^total|grand\s*total|கூடுதல்"
SHARE = r"(?i)\d+\s*[-–]?\s*(?:ல்|இல்)\s*\d+\s*பங்க|பங்கில்|\bshare\b"
#: Types of a cell in the order they are tried: an extent H.AA.SS or H-AA, an amount, a survey number with its part, a decimal, a long number, a short one, a part, words.
TYPES = (
    ("share", SHARE),
    ("ha", r"^(?:\d{1,4}\s*[.:]\s*\d{1,2}\s*[.:]\s*\d{1,2}|\d{1,3}\s*[-–]\s*\d{1,2}(?:\.\d{1,2})?|0\d\d\.\d\d)\.?$"),
    ("money", r"\d{1,3}(?:,\d\d)*,\d{3}|\d.*/-|/-.*\d|₹.*\d|\d.*₹|ரூ\.?\s*\d"),
    ("survey", r"^\d{1,4}\s*/\s*[0-9A-Za-z][0-9A-Za-z,\s]*(?:\(.*\))?$"),
    ("dec", r"^\d{1,5}\.\d{1,3}\.?$"),
    ("bignum", r"^\d{6,9}(?:\.\d{1,2})?\.?$"),
    ("int", r"^\d{1,5}\.?$"),
    ("subdiv", r"^(?:\d{1,3}[A-Za-z]{1,2}\d?|\d{1,3}(?:,\s*\d{1,3}[A-Za-z]?)+)\.?$"),
    ("text", r"(?:[A-Za-z\x{0B80}-\x{0BFF}].*){3}"),
)
#: Fields that a column of a type may hold, where its label doesn't say.
CONTENT = {"ha": "extent_ha", "survey": "survey_no", "money": "amount_rs", "bignum": "amount_rs", "text": "owner", "share": "share", "dec": "extent_ac"}
#: Spellings of fields in labels, lower case and without blanks; the first field with one counts.
LABELS = {
    "serial": ("s.no", "sl.no", "serial", "வ.எண்"), "survey_no": ("survey", "s.f.no", "புல"), "sub_div": ("subdiv", "உட்பிரிவு"), "extent_ha": ("hect", "extent", "ஹெக்"), "extent_ac": ("acre", "ஏக்"),
    "owner": ("owner", "name", "உரிமையாளர்", "பெயர்"), "amount_rs": ("amount", "compensation", "தொகை"), "share": ("share", "பங்கு"), "remarks": ("remark", "குறிப்பு"),
}
#: Two sums are the same below this; a row that is no data has none of these fields.
SAME, KEYS, ROW_KEYS = 0.0006, ("serial", "survey_no", "owner", "sub_div"), ("serial", "owner", "survey_no", "extent_ha")


def filled(text: Column) -> Column:
    """The cell without blanks around it; null where it is empty."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(~F.lower(bare).isin(*EMPTY), bare)


def cell_type(text: Column) -> Column:
    """empty, the first type whose pattern the cell has, or other."""
    cell = normalise.tamil_digits(filled(text))
    kind = F.when(cell.isNull(), "empty")
    for name, pattern in TYPES:
        kind = kind.when(cell.rlike(pattern), name)
    return kind.otherwise("other")


def column_types(cells: DataFrame, table: Sequence[str]) -> DataFrame:
    """table, col, type, type_share, n of every column with a filled cell: most cells' type, the one tried first on a tie."""
    rank = {name: -i for i, (name, _) in enumerate(TYPES)}
    first = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    votes = cells.withColumn("type", cell_type(F.col("text"))).where("type <> 'empty'").groupBy(*table, "col", "type").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", F.coalesce(F.try_element_at(first, F.col("type")), F.lit(-len(rank))).alias("first"), "type"))
    return votes.groupBy(*table, "col").agg(best.alias("b"), F.sum("n").alias("n")).select(*table, "col", "b.type", (F.col("b.n") / F.col("n")).alias("type_share"), "n")


def label_field(label: Column, labels: Mapping[str, Sequence[str]] = LABELS) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", "")
    holds = lambda spellings: F.exists(F.array(*[F.lit(s) for s in spellings]), lambda s: F.contains(low, s))
    return F.coalesce(*[F.when(holds(spellings), field) for field, spellings in labels.items()], F.lit(None).cast("string"))


def column_fields(cells: DataFrame, labels: DataFrame, table: Sequence[str], names: Mapping[str, Sequence[str]] = LABELS, content: Mapping[str, str] = CONTENT) -> DataFrame:
    """table, col, field, how (label or content), type, type_share: at most one column a field and table, at most one field a column.

    A label names a column's field; of several columns the leftmost filled one has it. Columns that no label names are given the field of their
    type, leftmost first, if no label of the table gave it away."""
    types = column_types(cells, table)
    known = labels.select(*table, "col", label_field(F.col("label"), names).alias("named"))
    both = types.join(known, [*table, "col"], "left")
    of_type = F.create_map(*[F.lit(x) for pair in content.items() for x in pair])
    both = both.withColumns({"field": F.coalesce("named", F.try_element_at(of_type, F.col("type"))), "how": F.when(F.col("named").isNotNull(), "label").otherwise("content")})
    order = Window.partitionBy(*table, "field").orderBy(F.col("how").desc(), "col")  # label before content; as many rows as a table has columns
    return both.where("field is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*table, "col", "field", "how", "type", "type_share")


def wide_rows(cells: DataFrame, fields: DataFrame, table: Sequence[str], names: Sequence[str]) -> DataFrame:
    """table, row, _total (a cell says so), and the text of every field of every row with a filled cell."""
    said = cells.withColumn("text", filled(F.col("text"))).where("text is not null")
    met = said.join(fields.select(*table, "col", "field"), [*table, "col"], "left")
    of = [F.min(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in names]
    return met.groupBy(*table, "row").agg(F.bool_or(F.col("text").rlike(TOTAL)).alias("_total"), *of)


def in_ranges(rows: DataFrame, table: Sequence[str], order: str) -> DataFrame:
    """rows sorted by _table (the table's key as text) and order, dealt to tasks in ranges of both."""
    key = F.to_json(F.struct(*table), {"ignoreNullFields": "false"})
    return rows.withColumn("_table", key).repartitionByRange("_table", order).sortWithinPartitions("_table", order)


def subtotals(rows: DataFrame, table: Sequence[str], order: str, value: Column, keyed: Column, same: float = SAME) -> DataFrame:
    """rows and is_total: a row with a value but no key whose value is the sum of all since the last total, of at least two rows (or one, if the table ends there).

    First each stretch up to a row without a key becomes one line (its sum and number of rows), range by range; then those lines are gone through table by table."""
    narrow = rows.select(*table, F.col(order).alias("_order"), value.cast("double").alias("_value"), F.coalesce(keyed, F.lit(False)).alias("_keyed"))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = ~b["_keyed"] & b["_value"].notna()
            b["_piece"] = (ends.shift(fill_value=False) | (b["_table"] != b["_table"].shift())).cumsum()
            b["_sum"], b["_rows"] = b["_value"].fillna(0.0).where(~ends, 0.0), (~ends).astype("int64")
            out = b.groupby("_piece").agg(_table=("_table", "first"), first=("_order", "first"), sum=("_sum", "sum"), rows=("_rows", "sum"), last=("_order", "last"))
            tail = b.groupby("_piece").tail(1).set_index("_piece")
            out["ends"], out["value"] = ~tail["_keyed"] & tail["_value"].notna(), tail["_value"]
            yield out.reset_index(drop=True)[["_table", "first", "last", "sum", "rows", "ends", "value"]]

    kind = dict(narrow.dtypes)["_order"]
    pieces = in_ranges(narrow, table, "_order").select("_table", "_order", "_value", "_keyed").mapInPandas(stretches, f"_table string, first {kind}, last {kind}, sum double, rows long, ends boolean, value double")

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, run, n, kept, waiting = None, 0.0, 0, False, None
        for b in batches:
            found = []
            for key, at, total, rows_, ends, v in zip(b["_table"], b["last"], b["sum"], b["rows"], b["ends"], b["value"], strict=True):
                if key != now:
                    if waiting is not None:  # the table before ended with it
                        found.append((now, waiting[0]))
                    now, run, n, kept, waiting = key, 0.0, 0, False, None
                if waiting is not None:  # not the last row: it counts as data
                    run, n, kept, waiting = run + waiting[1], n + 1, True, None
                run, n, kept = run + total, n + rows_, kept or rows_ > 0
                if ends and kept and abs(v - run) < same:
                    if n >= 2:
                        found.append((key, at))
                        run, n = 0.0, 0
                    else:
                        waiting = (at, v)
                elif ends:
                    run, n, kept = run + v, n + 1, True
            yield pd.DataFrame(found, columns=["_table", "_order"])
        if waiting is not None:
            yield pd.DataFrame([(now, waiting[0])], columns=["_table", "_order"])

    found = pieces.repartition("_table").sortWithinPartitions("_table", "first").mapInPandas(totals, f"_table string, _order {kind}")
    found = cut(found).withColumnRenamed("_order", order).withColumn("is_total", F.lit(True))
    key = F.to_json(F.struct(*table), {"ignoreNullFields": "false"})
    return rows.withColumn("_table", key).join(found, ["_table", order], "left").withColumn("is_total", F.coalesce("is_total", F.lit(False))).drop("_table")


def heads(rows: DataFrame, table: Sequence[str], order: str, starts: Column) -> DataFrame:
    """rows and head: the order of the last row at or before each that starts a group of its table; null before the first.

    A range can't know the head that came before it: it only knows that its first rows have none. The last head of each range goes to the driver, one line a range, and back."""
    ranged = cut(in_ranges(rows.withColumn("_starts", F.coalesce(starts, F.lit(False))), table, order).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range", "_table").orderBy(order)  # within one task's range, whatever a table's length
    local = ranged.withColumn("head", F.last(F.when(F.col("_starts"), F.col(order)), True).over(w))
    ends = ranged.groupBy("_range").agg(F.min("_table").alias("first"), F.max("_table").alias("last"))
    tails = ranged.join(F.broadcast(ends.select("_range", F.col("last").alias("_table"))), ["_range", "_table"]).where("_starts").groupBy("_range").agg(F.max(order).alias("head"))
    known, carried, above = {r["_range"]: r["head"] for r in tails.collect()}, [], (None, None)
    for r in sorted(ends.collect()):
        before = above[1] if above[0] == r["first"] else None
        if before is not None:
            carried.append((r["_range"], r["first"], before))
        above = (r["last"], known.get(r["_range"], before if r["first"] == r["last"] else None))
    kind = dict(rows.dtypes)[order]
    before = F.broadcast(rows.sparkSession.createDataFrame(carried, f"_range int, _table string, _before {kind}"))
    out = local.join(before, ["_range", "_table"], "left").withColumn("head", F.coalesce("head", "_before"))
    return out.drop("_before", "_range", "_table", "_starts")


def merged_rows(rows: DataFrame, table: Sequence[str], share: str = "share", amounts: Sequence[str] = ("amount_rs",)) -> DataFrame:
    """rows without wrapped ones: a row without a serial, owner, survey or extent goes on with the row above it. Its share is added, its amount taken if there is none."""
    own = F.coalesce(*[F.col(k) for k in ROW_KEYS]).isNotNull()
    grouped = heads(rows, table, "row", own).withColumn("head", F.coalesce("head", "row"))  # what stands above the first row of its own goes on with nothing
    rest = [c for c in rows.columns if c not in (*table, "row", share, *amounts)]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("row", c)))[c].alias(c)
    shares = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(share).isNotNull(), F.struct("row", share)))), lambda s: s[share]), " ")
    out = grouped.groupBy(*table, "head").agg(*[F.min(F.when(F.col("row") == F.col("head"), F.col(c))).alias(c) for c in rest], *[first(a) for a in amounts], F.nullif(shares, F.lit("")).alias(share))
    return out.withColumnRenamed("head", "row").select(rows.columns)


def parcel_records(cells: DataFrame, labels: DataFrame, table: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records of the rows of parcel tables, and the tables' totals.

    Records: table, row, serial, survey_no, owner, extent_ha, extent_ac, amount_rs, share, group_row (row of the group's printed survey), filled (survey taken from it), moved (extent
    moved to the head, as one member alone had one). Totals: table, row, kind (labelled or unlabelled), extent_ha, amount_rs."""
    names = list(LABELS)
    fields = cut(column_fields(cells, labels, table))
    rows = cut(wide_rows(cells, fields, table, names))
    ha = normalise.extent_ha(F.col("extent_ha"))
    checked = cut(subtotals(rows.where(~F.col("_total")), table, "row", ha, F.coalesce(*[F.col(k) for k in KEYS]).isNotNull()))
    totals = rows.where("_total").withColumn("kind", F.lit("labelled")).unionByName(checked.where("is_total").drop("is_total").withColumn("kind", F.lit("unlabelled")))
    data = merged_rows(checked.where(~F.col("is_total")).drop("is_total", "_total"), table)
    grouped = cut(heads(data, table, "row", F.col("survey_no").isNotNull()))

    extent = F.col("extent_ha").isNotNull() | F.col("extent_ac").isNotNull()
    member = F.col("row") > F.col("head")
    group = grouped.where("head is not null").groupBy(*table, "head").agg(
        F.max(F.when(~member, F.col("survey_no"))).alias("_survey"), F.bool_or(~member & extent).alias("_own"), F.count_if(member & extent).alias("_n"),
        F.max(F.when(member & extent, F.struct("extent_ha", "extent_ac"))).alias("_theirs"),
    )
    same = [grouped[c].eqNullSafe(group[c]) for c in (*table, "head")]
    met = grouped.join(group, same, "left").select(grouped["*"], "_survey", "_own", "_n", "_theirs")
    moves = ~F.coalesce("_own", F.lit(True)) & (F.col("_n") == 1)
    of = lambda c: F.when(moves & ~member, F.col("_theirs")[c]).when(~moves | F.col("head").isNull(), F.col(c))
    records = met.select(
        *table, "row", "serial", F.coalesce("survey_no", "_survey").alias("survey_no"), "owner", normalise.extent_ha(of("extent_ha")).alias("extent_ha"), normalise.extent_ac(of("extent_ac")).alias("extent_ac"),
        normalise.amount(F.col("amount_rs")).alias("amount_rs"), "share", F.col("head").alias("group_row"), (F.col("survey_no").isNull() & F.col("_survey").isNotNull()).alias("filled"), (moves & ~member).alias("moved"),
    )
    return records, totals.select(*table, "row", "kind", ha.alias("extent_ha"), normalise.amount(F.col("amount_rs")).alias("amount_rs"))
