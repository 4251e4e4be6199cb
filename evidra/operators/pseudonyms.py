"""Pseudonyms: names, numbers and amounts give way to stable tokens, come back exactly, and what is left raw is found.

Known names are matched by an automaton over all of them in one pass of each text. The automaton is broadcast, so its
names are bounded by NAME_BYTES; more names go in blocks of that size, one pass each, and nothing is left out. Tokens are
numbered by sorted ranges with offsets, so a scope with most of the values is never one group."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut

#: The form of a token, tiers of privacy, kinds of facts and of fields, words that stand before or after a name, amounts.
TOKEN = r"⟨[A-Z]+_[0-9]+⟩"
TIERS = ("PII", "PSEUDO", "PUBLIC")
FACT_KINDS = {"owner": "OWNER", "patta_no": "PATTA", "amount_rs": "AMT"}
FIELD_KINDS = {
    "OWNER": "owner owner_name owners father_name husband_name guardian_name relation_name canonical_name variants raw_text name_variants owner_raw".split(),
    "PATTA": "patta_no patta patta_number".split(),
    "AMT": "amount_rs amount compensation_rs owner_amount_rs".split(),
}
RAW_FIELDS = "owner owner_name owners patta_no patta patta_number father_name husband_name guardian_name".split()
SLASHED, TAMIL, TITLES = "S/o W/o D/o C/o".split(), "க/பெ த/பெ மகன் மனைவி மகள்".split(), "Thiru Tmt Selvi".split()
LETTER = "A-Za-z஀-௿"
AMOUNT = r"(?:₹|Rs\.?|INR)\s*[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*/-)?"

MARKER = "(?:" + "|".join([rf"\b{w}" for w in SLASHED] + TAMIL + [rf"\b{w}\.?" for w in TITLES]) + r")(?:\s*[.:\-]\s*|\s+)"
FIRST = rf"[{LETTER}][{LETTER}.]{{2,}}"
AFTER = rf"{MARKER}(?!⟨)({FIRST}(?:\s+[A-Z஀-௿][{LETTER}.]+)?)"
BEFORE = rf"([஀-௿][஀-௿.]{{2,}})\s+(?:{'|'.join(TAMIL)})"
#: Names of one automaton, in bytes of UTF-8 (some hundred times that in memory).
NAME_BYTES = 1 << 20
SHORTEST = 3

HIT = pa.struct([("column", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
HITS = "array<struct<column:int,start:int,end:int,kind:string,value:string>>"
PRIVATE = pa.struct([("column", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string())])
PRIVATES = "array<struct<column:string,start:int,end:int,raw:string>>"


def lowered(text: str) -> str:
    """Lower case, one character for one, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def clean_names(names: DataFrame, column: str, stop: Sequence[str] = ()) -> DataFrame:
    """Names of four characters or more, at most five words, no digit or percent sign, none of the stop words; distinct."""
    words = F.split(F.trim(column), r"\s+")
    stopped = F.arrays_overlap(F.transform(words, F.lower), F.array(*[F.lit(w.lower()) for w in stop]).cast("array<string>"))
    return names.select(F.trim(column).alias("name")).where((F.length("name") >= 4) & (F.size(words) <= 5) & ~F.col("name").rlike("[0-9%]") & ~stopped).distinct()


def _blocks(names: DataFrame | None, shortest: int) -> Iterator[list[str]]:
    """The distinct names in blocks of about NAME_BYTES, one at a time on the driver; a single empty block if there are none."""
    if names is None:
        yield []
        return
    known = cut(names.select(F.trim(F.col(names.columns[0]).cast("string")).alias("name")).where(F.length("name") >= shortest).distinct())
    n = -(-(known.agg(F.sum(F.octet_length("name"))).first()[0] or 1) // NAME_BYTES)
    for i in range(n):
        yield [r["name"] for r in known.where(F.pmod(F.xxhash64(F.lower("name")), F.lit(n)) == i).collect()]


def _machine(names: Sequence[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for name in sorted(names, reverse=True):
        machine.add_word(lowered(name), name)
    machine.make_automaton()
    return machine if names else None


def _known(machine, text: str) -> Iterator[tuple[int, int, str]]:
    """start, end and name of every place of a known name; ASCII names only where no Latin letter touches them."""
    low = lowered(text)
    latin = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalpha()
    for last, name in machine.iter(low):
        start = last + 1 - len(name)
        if not (name.isascii() and (latin(start - 1) or latin(last + 1))):
            yield start, last + 1, name


def _spans(text: str, places: list[tuple[int, int, str]], amounts: bool) -> list[tuple[int, int, str, str]]:
    """Spans of one text: leftmost and longest known names first, then names by words before and after them, then amounts, in what is left. Tokens already there are left alone."""
    found: list[tuple[int, int, str, str]] = []
    masked = re.sub(TOKEN, lambda m: "⟨" * len(m[0]), text)
    end = 0
    for start, stop, name in sorted(places, key=lambda p: (p[0], -p[1], p[2])):
        if start >= end and "⟨" not in masked[start:stop]:
            found.append((start, stop, "OWNER", name))
            end = stop
    for pattern, kind, group in ((AFTER, "OWNER", 1), (BEFORE, "OWNER", 1), *(((AMOUNT, "AMT", 0),) if amounts else ())):
        masked = _mask(masked, found)
        found += [(*m.span(group), kind, m[group]) for m in re.finditer(pattern, masked)]
    return sorted(found)


def _mask(text: str, spans: Sequence[tuple]) -> str:
    parts, at = [], 0
    for start, end, *_ in sorted(spans):
        parts += [text[at:start], "⟨" * (end - start)]
        at = end
    return "".join([*parts, text[at:]])


def _row_id(columns: Sequence[str]) -> Column:
    """A key of a row's contents: repeated rows share it, as they share their spans."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in columns]))


def _scope(scope: Column | str | None) -> Column:
    """A scope that is never null."""
    return F.lit("") if scope is None else F.coalesce(F.concat(F.lit("="), (F.col(scope) if isinstance(scope, str) else scope).cast("string")), F.lit(""))


def _unscope(c: str) -> Column:
    return F.when(F.length(c) > 0, F.substring(F.col(c), 2, 1 << 30))


def fact_kinds(fact_type: Column) -> Column:
    """The kind of a long-form fact's value, null for facts that stay."""
    return reduce(lambda c, x: c.when(F.lower(fact_type) == x[0], x[1]), FACT_KINDS.items(), F.when(F.lit(False), ""))


def field_kinds(columns: Sequence[str]) -> dict[str, str]:
    """Those of the columns whose names mark them as names, numbers or amounts, with their kinds."""
    return {c: kind for c in columns for kind, names in FIELD_KINDS.items() if c.lower() in names}


def _kinds(columns: Sequence[str], kinds: Mapping[str, Column | str] | None) -> Column:
    given = dict(kinds or {})
    return F.array(*[(k if isinstance(k := given.get(c), Column) else F.lit(k)).cast("string") for c in columns])


def find(rows: DataFrame, keep: Sequence[Column], columns: Sequence[str], names: DataFrame | None = None, kinds: Mapping[str, Column | str] | None = None, amounts: bool = True) -> DataFrame:
    """The columns to keep, and hits: column number, start, end (code points), kind and value of everything to be replaced, for rows that have any.

    Where a column's kind is given and not null, its whole stripped value is one hit, unless it is blank or a token; other
    values are searched as texts. Null and empty texts have no hits."""
    texts = F.array(*[F.col(c).cast("string") for c in columns])
    df = rows.select(F.struct(*keep).alias("keep"), texts.alias("texts"), _kinds(columns, kinds).alias("kinds"), F.array().cast(HITS).alias("hits"))
    for block, last in _lookahead(_blocks(names, SHORTEST)):
        search = _searcher(rows.sparkSession.sparkContext.broadcast(block), last, amounts)
        df = df.mapInArrow(search, df.select("keep", "hits").schema if last else df.schema)
        df = df if last else cut(df)
    return df.where(F.size("hits") > 0).select("keep.*", "hits")


def _lookahead(items: Iterator) -> Iterator[tuple]:
    items = iter(items)
    now = next(items)
    for following in items:
        yield now, False
        now = following
    yield now, True


def _searcher(shared, last: bool, amounts: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in batches:
            found = []
            for texts, kinds, hits in zip(*[batch.column(c).to_pylist() for c in ("texts", "kinds", "hits")], strict=True):
                mine = [(h["column"], h["start"], h["end"], h["kind"], h["value"]) for h in hits]
                mine += [(i, s, e, "", v) for i, t in enumerate(texts) if t and machine and kinds[i] is None for s, e, v in _known(machine, t)]
                if last:
                    mine = list(_resolve(texts, kinds, mine, amounts))
                found.append([dict(zip(("column", "start", "end", "kind", "value"), h, strict=True)) for h in mine])
            hits = pa.array(found, pa.list_(HIT))
            data = {c: hits if c == "hits" else batch.column(c) for c in (("keep", "hits") if last else batch.schema.names)}
            yield pa.RecordBatch.from_pydict(data)

    return search


def _resolve(texts: list, kinds: list, places: list[tuple], amounts: bool) -> Iterator[tuple]:
    for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
        if kind is None:
            yield from ((i, *s) for s in _spans(text or "", [(s, e, v) for c, s, e, _, v in places if c == i], amounts))
        elif (value := (text or "").strip()) and not re.fullmatch(TOKEN, value):
            yield i, 0, len(text), kind, value


def number(values: DataFrame) -> DataFrame:
    """scope, kind, folded, value, token of rows of scope, kind, value and at (a place that sorts): one token for all spellings that differ in case, numbered from 1 per scope and kind in the order first seen.

    Sorted ranges of rows are counted, counts before a range are added: no scope is gathered."""
    first = values.groupBy("scope", "kind", F.lower("value").alias("folded")).agg(F.min(F.struct("at", "value")).alias("first"))
    ranges = first.repartitionByRange("scope", "kind", "first", "folded").withColumn("part", F.spark_partition_id())
    ranges = cut(ranges)
    group = ["scope", "kind"]
    counts = ranges.groupBy("part", *group).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part", *group).orderBy("first", "folded")) + F.col("before")
    placed = ranges.join(counts.select("part", *group, before.alias("before")), ["part", *group]).select(*group, "folded", F.col("first.value").alias("value"), place.alias("n"))
    return placed.select(*group, "folded", "value", F.concat(F.lit("⟨"), "kind", F.lit("_"), "n", F.lit("⟩")).alias("token"))


def pseudonymise(
    rows: DataFrame, key: str, columns: Sequence[str], scope: str | None = None, names: DataFrame | None = None, kinds: Mapping[str, Column | str] | None = None, amounts: bool = True, private: str = "private"
) -> tuple[DataFrame, DataFrame]:
    """The rows with tokens in the columns, and the mapping scope, token, kind, value that reinsert takes.

    names: a table whose first column holds known names. kinds: kinds of whole fields by column (see field_kinds,
    fact_kinds). Columns become strings. The rows' column `private` lists what stood where (`restore` takes it); it and the
    mapping stay with the owner. Null values stay null, rows without hits stay as they are, repeated rows get equal tokens,
    a null scope is a scope of its own, an empty table gives two empty ones; the order first seen is that of key (nulls
    first), column and place."""
    columns = list(columns)
    tagged = rows.withColumns({"_id": F.md5(F.concat_ws("|", _row_id([key, *columns, *([scope] if scope else [])]), F.to_json(_kinds(columns, kinds)))), "_scope": _scope(scope)})
    found = find(tagged, [F.col("_id"), F.col("_scope"), F.col(key).alias("_key")], columns, names, kinds, amounts)
    found = cut(found.dropDuplicates(["_id"]).select("_id", "_scope", "_key", F.inline("hits")))
    at = F.struct("_key", "column", "start")
    tokens = cut(number(found.select(F.col("_scope").alias("scope"), "kind", "value", at.alias("at"))))
    hits = found.withColumn("folded", F.lower("value")).join(tokens.withColumnRenamed("scope", "_scope").drop("value"), ["_scope", "kind", "folded"])
    by_row = hits.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("column", "start", "end", "token"))).alias("_hits"))
    casts = {c: F.col(c).cast("string") for c in columns}
    joined = tagged.withColumns(casts).join(by_row, "_id", "left").select(*rows.columns, "_hits")
    kept = joined.select(F.struct(*rows.columns).alias("row"), F.array(*columns).alias("texts"), "_hits")
    replaced = kept.mapInArrow(_replacer(columns), f"row {kept.schema['row'].dataType.simpleString()}, texts array<string>, {private} {PRIVATES}")
    out = [F.get("texts", F.lit(columns.index(c))).alias(c) if c in columns else F.col("row")[c].alias(c) for c in rows.columns]
    return replaced.select(*out, private), tokens.select(_unscope("scope").alias("scope"), "token", "kind", "value")


def _replacer(columns: Sequence[str]):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, privates = [], []
            for row, hits in zip(batch.column("texts").to_pylist(), batch.column("_hits").to_pylist(), strict=True):
                private = []
                for h_column in sorted({h["column"] for h in hits or ()}):
                    row[h_column], mine = _swap(row[h_column], [h for h in hits if h["column"] == h_column])
                    private += [{"column": columns[h_column], "start": s, "end": e, "raw": raw} for s, e, raw in mine]
                texts.append(row)
                privates.append(private)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.list_(pa.string())), pa.array(privates, pa.list_(PRIVATE))], ["row", "texts", "private"])

    return replace


def _swap(text: str, hits: list[dict]) -> tuple[str, list[tuple[int, int, str]]]:
    parts, private, at, length = [], [], 0, 0
    for h in hits:
        parts += [text[at : h["start"]], h["token"]]
        length += h["start"] - at + len(h["token"])
        private.append((length - len(h["token"]), length, text[h["start"] : h["end"]]))
        at = h["end"]
    return "".join([*parts, text[at:]]), private


def restore(rows: DataFrame, columns: Sequence[str], private: str = "private") -> DataFrame:
    """The exact inverse of pseudonymise (as strings): every spelling as it stood, whatever else looks like a token; the private column goes."""
    columns = list(columns)
    kept = rows.select(F.struct(*rows.columns).alias("row"), F.array(*columns).alias("texts"), F.col(private).alias("private"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("texts").to_pylist()
            for row, spans in zip(texts, batch.column("private").to_pylist(), strict=True):
                for i, column in enumerate(columns):
                    if mine := [{"start": s["start"], "end": s["end"], "token": s["raw"]} for s in spans or () if s["column"] == column]:
                        row[i] = _swap(row[i], mine)[0]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.list_(pa.string()))], ["row", "texts"])

    done = kept.mapInArrow(back, f"row {kept.schema['row'].dataType.simpleString()}, texts array<string>")
    return done.select(*[F.get("texts", F.lit(columns.index(c))).alias(c) if c in columns else F.col("row")[c].alias(c) for c in rows.columns if c != private])


def reinsert(rows: DataFrame, column: str, mapping: DataFrame, scope: str | None = None) -> DataFrame:
    """Texts written by others with their tokens replaced by the values of the rows' scope; tokens that the mapping lacks stay. JVM-side; rows keep their columns."""
    asked = rows.withColumns({"_id": _row_id([column, *([scope] if scope else [])]), "_scope": _scope(scope)})
    tokens = F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))
    uses = asked.select("_id", "_scope", F.posexplode(tokens).alias("n", "token")).dropDuplicates(["_id", "n"])
    known = mapping.select(_scope("scope").alias("_scope"), "token", "value")
    values = uses.join(known, ["_scope", "token"], "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("value", "token").alias("value")))).alias("_values"))
    pieces = F.split(F.col(column), TOKEN, -1)
    filled = F.array_join(F.flatten(F.zip_with(pieces, F.coalesce(F.col("_values.value"), F.array().cast("array<string>")), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    return asked.join(values, "_id", "left").select(*[filled.alias(c) if c == column else F.col(c) for c in rows.columns])


def residual(rows: DataFrame, columns: Sequence[str], names: DataFrame) -> DataFrame:
    """name, n_rows: names of more than three characters that still stand anywhere in the columns, in any case, also within words."""
    texts = rows.select(F.array(*[F.col(c).cast("string") for c in columns]).alias("texts"))
    found = None
    for block in _blocks(names, SHORTEST + 1):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        part = texts.mapInArrow(_counter(shared), "name string, n long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("name").agg(F.sum("n").alias("n_rows"))


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, spellings = _machine(shared.value), {}
        for name in shared.value:
            spellings.setdefault(lowered(name), []).append(name)
        for batch in batches:
            n: dict[str, int] = {}
            for texts in batch.column("texts").to_pylist() if machine else ():
                for folded in {lowered(name) for t in texts if t for _, name in machine.iter(lowered(t))}:
                    for name in spellings[folded]:
                        n[name] = n.get(name, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["name", "n"])

    return count


def raw_hits(columns: Sequence[str]) -> Column:
    """Sorted signs of raw personal data in a row: 'field:<column>' for fields of RAW_FIELDS that hold more than a token, 'relation_marker' where a word like S/o stands before a raw name."""
    fields = [F.when((F.trim(c) != "") & ~F.trim(F.col(c).cast("string")).rlike(f"^{TOKEN}$"), F.lit(f"field:{c}")) for c in columns if c.lower() in RAW_FIELDS]
    marked = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").rlike(AFTER), F.lit(False)) for c in columns])
    return F.sort_array(F.array_compact(F.array(*fields, F.when(marked, F.lit("relation_marker")))))


def effective_tier(declared: Column, columns: Sequence[str]) -> Column:
    """struct(tier, notes): what isn't a known tier counts as PII, and so does a row with raw personal data, whatever was declared."""
    stripped, hits = F.upper(F.trim(F.coalesce(declared, F.lit("")))), raw_hits(columns)
    tier = F.when(stripped.isin(*TIERS), stripped).otherwise("PII")
    raised = (tier != "PII") & (F.size(hits) > 0)
    unknown = F.when(tier != stripped, F.concat(F.lit("unknown tier "), F.coalesce(declared, F.lit("null")), F.lit(" taken as PII")))
    notes = F.array_compact(F.array(unknown, F.when(raised, F.concat(F.lit("raised from "), tier, F.lit(": "), F.array_join(hits, ",")))))
    return F.struct(F.when(raised, "PII").otherwise(tier).alias("tier"), notes.alias("notes"))
