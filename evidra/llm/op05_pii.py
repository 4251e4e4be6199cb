"""Information-theoretic sanitisation of personal data [native].

Protected entities are the e-mail addresses, IP addresses, card numbers and phone numbers of a
text. A term (a word of four letters or more) discloses an entity if seeing the term tells most of
what seeing the entity would: its pointwise mutual information with the entity, estimated from
co-occurrence over all documents, is measured against the entity's own information content,
log2(n t,e * n / (n t * n e)) / log2(n / n e). From `remove` on the term is removed, from `generalise`
on it is replaced by the kind of entity it tells of. Co-occurring means standing anywhere in the same text, and
the term is masked wherever it stands in a text of that entity. A pair needs `support` distinct texts.

Only DataFrame functions are used. The spans of a kind come from the matches and the pieces
between them, whose lengths add up to positions (code points). The patterns carry look-behinds and possessive
repeats that leave their matches unchanged but keep long runs from being tried again at each place.
Places and masks are worked out in folds of bounded length, so a text of many entities costs as much a
character as any other. Word counts are summed in each task before they are shuffled by hash, copies of a
text are one row before terms are looked at, and joins on entity, term or text part the hot ones.

Edge cases: null and empty text have no spans; overlapping spans of different kinds are all reported, and masked as
one run; repeated rows are reported each; an empty table gives an empty result; other columns are not read by the query
and kept by the stage, where n_chars is counted anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, hot_keys, spread_join

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be there for a pattern to be tried at all.
TRY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: A term that is only generalised becomes the kind of entity it tells of.
TERM_MASKS = {"email": "[EMAIL TERM]", "ip": "[IP TERM]", "card": "[CARD TERM]", "phone": "[PHONE TERM]"}
WORD = r"\p{L}{4,}"
MARK = "\U00012543"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Elements that one fold looks at, and code points of a piece of text.
FOLD, PIECE = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op has made of all values before each one, and of all at the end (one element more than values).

    Folds of FOLD elements, then a fold over their results: the work grows with the number of values, not its square."""

    def fold(some: Column, first: Column) -> Column:
        empty = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, empty, lambda a, x: F.struct(op(a["now"], x).alias("now"), F.array_append(a["out"], a["now"]).alias("out")))

    def whole(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int")), lambda b: fold(F.slice(values, b * FOLD + 1, FOLD), start))

        def joined_(done: Column) -> Column:
            ahead = fold(F.transform(done, lambda d: d["now"]), start)
            return let(ahead, lambda a: F.array_append(F.flatten(F.zip_with(done, a["out"], lambda d, x: F.transform(d["out"], lambda y: op(x, y)))), a["now"]))

        return let(blocks, joined_)

    return F.when(F.size(values) == 0, F.array(start)).otherwise(whole(values))


def sums(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match: lengths of the pieces between and of the matches add up."""

    def of(found: Column, between: Column) -> Column:
        sizes = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap"), F.length(v).alias("size")))

        def placed(sizes: Column) -> Column:
            before = F.slice(sums(F.transform(sizes, lambda x: x["gap"] + x["size"])), 1, F.size(sizes))
            return F.zip_with(sizes, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))

        return let(sizes, placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda between: of(found, between)))


def rebuilt(text: Column, spans: Column, put: Callable[[Column, Column, Callable[[Column, Column], Column]], Column]) -> Column:
    """The text with every run of overlapping spans replaced by put(first span, end of the run, substring of from and to).

    The text is held in pieces, so that a place in it is found without walking to it."""

    def of(pieces: Column, spans: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
            here = F.substring(piece(first), a % PIECE + 1, b - a)
            across = F.concat(F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(piece(last), F.lit(1), b % PIECE))
            return F.when(b <= a, F.lit("")).when(first == last, here).otherwise(across)

        def runs(ends: Column) -> Column:
            zipped = F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda s, e: F.struct(s.alias("s"), e.alias("after")))
            first = F.filter(zipped, lambda r: r["s"]["start"] >= r["after"])

            def out(first: Column) -> Column:
                stops = F.array_append(F.transform(F.slice(first, 2, F.size(first)), lambda r: r["after"]), F.element_at(ends, -1))
                said = F.zip_with(first, stops, lambda r, stop: F.concat(between(r["after"], r["s"]["start"]), put(r["s"], stop, between)))
                return F.concat(F.array_join(said, ""), between(F.element_at(ends, -1), F.lit(PIECE) * F.size(pieces)))

            return let(first, out)

        return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)), runs)

    return let(spans, lambda spans: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: of(pieces, spans)))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by start, then kind."""

    def of(i: int, kind: str) -> Column:
        spans = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        typed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
        there = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(TRY[kind])
        return F.when(there, typed.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS[:4])]))


def joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column, spans: Column) -> Column:
    """The text with spans blanked at the same length; an edge of a span that is a letter becomes the letter MARK (of a script so rare that words holding it are left out)."""

    def put(s: Column, stop: Column, between) -> Column:
        edge = lambda a: F.when(between(a, a + 1).rlike(r"\p{L}"), F.lit(MARK)).otherwise(F.lit(" "))
        return F.concat(edge(s["start"]), F.repeat(F.lit(" "), stop - s["start"] - 2), edge(stop - 1))

    return rebuilt(text, spans, put)


def word_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def free_words(blank: Column) -> Column:
    """Hashes of the distinct words of a text that no span overlaps."""
    found = F.filter(F.regexp_extract_all(blank, F.lit(WORD), F.lit(0)), lambda w: ~F.contains(w, F.lit(MARK)))
    return F.array_distinct(F.transform(found, word_hash))


def flagged_spans(blank: Column, flagged: Column) -> Column:
    """Spans of the free words whose hash is a key of flagged; the value says what becomes of them."""
    typed = F.transform(matches(blank, WORD), lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["end"].alias("end"), F.try_element_at(flagged, word_hash(m["value"])).alias("value")))
    return F.filter(typed, lambda s: s["value"].isNotNull()).cast(SPAN)


def terms(docs: DataFrame, hits: DataFrame, *, text: str = "text", support: int = 3, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """node, copies, extra: spans of disclosing terms in each text with an entity; value says what becomes of them.

    hits: node, text, spans of every document with an entity. Entities of the same texts are one class, as all their counts
    are equal, and words of fewer than `support` such texts go before words and classes meet, as no pair of theirs can reach it."""
    held = hits.groupBy("node").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    held = cut(held.select("node", "copies", "spans", blanked(F.col("text"), F.col("spans")).alias("blank")))
    entity = F.concat(F.col("s.kind").cast("string"), F.lit(":"), F.when(F.col("s.kind").isin(2, 3), F.regexp_replace("s.value", "[^0-9]", "")).otherwise(F.lower("s.value")))
    owns = cut(held.select("node", "copies", F.explode("spans").alias("s")).select("node", "copies", entity.alias("entity")).distinct())
    entities = owns.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    entities = cut(entities.where(F.col("texts") >= support))  # a pair can't stand in more texts than its entity
    owned = spread_join(owns, entities, ["entity"], hot_keys(entities, ["entity"], "texts"), ["node"])
    owned = owned.groupBy("node", "copies", F.struct("x", "y", "n_e").alias("class")).agg(F.min(F.substring("entity", 1, 1)).alias("kind"))
    of_node = cut(owned.groupBy("node").agg(F.collect_list(F.struct("class", "kind")).alias("classes")))  # no more than the text's own entities

    counted = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), word_hash))).alias("term"))
    counted = counted.groupBy("term").agg(F.count("*").alias("n_t"))
    in_text = cut(held.join(of_node.select("node"), "node").select("node", "copies", F.explode(free_words(F.col("blank"))).alias("term")))
    common = in_text.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support)
    common = cut(common.join(counted, "term"))
    n = float(docs.count())
    met = spread_join(in_text, common, ["term"], hot_keys(common, ["term"], "texts"), ["node"]).join(of_node, "node")
    # share >= generalise needs n_t <= n_e ** generalise * n ** (1 - generalise); the factor is for rounding
    near = F.filter("classes", lambda c: F.col("n_t") <= F.pow(c["class"]["n_e"], F.lit(generalise)) * (n ** (1 - generalise)) * 1.000001)
    pairs = cut(met.select("node", "copies", "term", "n_t", F.explode(near).alias("c")).select("node", "copies", "term", "n_t", "c.class", "c.kind"))
    told = pairs.groupBy("class", "term", "n_t").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    told = told.withColumn("n_e", F.col("class.n_e")).withColumn("share", F.log2(F.col("n_te") * F.lit(n) / (F.col("n_t") * F.col("n_e"))) / F.log2(F.lit(n) / F.col("n_e")))
    told = cut(told.where((F.col("n_e") < n) & (F.col("share") >= generalise)).select("class", "term", "texts", (F.col("share") >= remove).alias("goes")))
    flagged = spread_join(pairs.select("node", "class", "term", "kind"), told, ["class", "term"], hot_keys(told, ["class", "term"], "texts"), ["node"])
    flagged = flagged.groupBy("node", "term").agg(F.when(F.max("goes"), F.lit("remove")).otherwise(F.min("kind")).alias("action"))
    flagged = flagged.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("flagged"))
    return held.join(flagged, "node").select("node", "copies", flagged_spans(F.col("blank"), F.col("flagged")).alias("extra")).where(F.size("extra") > 0)


def node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def with_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, node, spans of every row, and the text (and what is carried) of rows with a span."""
    whole = F.coalesce(F.col(text), F.lit(""))
    row = carry if carry is not None else F.lit(None).cast("string")
    found = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), row.alias("row"), base_spans(whole).alias("spans"))
    has = F.size("spans") > 0
    return found.select("doc_id", "spans", F.when(has, node(F.col("text"))).alias("node"), F.when(has, F.col("text")).alias("text"), F.when(has, F.col("row")).alias("row"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans are one run with the first one's mask."""

    def put(s: Column, stop: Column, between) -> Column:
        masks = [F.when(s["kind"] == i, F.lit(MASKS[k])) for i, k in enumerate(KINDS[:4])]
        terms = [F.when(s["value"] == str(i), F.lit(TERM_MASKS[k])) for i, k in enumerate(KINDS[:4])]
        return F.coalesce(F.when(s["kind"] == 4, F.coalesce(*terms, F.lit(""))), *masks)

    return rebuilt(text, spans, put)


def with_terms(found: DataFrame, docs: DataFrame, text: str, **how) -> DataFrame:
    """found (rows with an entity), and `every`: its base spans and those of terms."""
    extra = cut(terms(docs, found.select("node", "text", "spans"), text=text, **how))
    rows = spread_join(found, extra.select("node", "extra"), ["node"], hot_keys(extra, ["node"], "copies"), ["_row"], "left")
    none = F.array().cast(SPAN)
    return rows.withColumn("extra", F.coalesce("extra", none)).withColumn("every", F.array_sort(F.concat("spans", "extra")))


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, number of spans of each base kind, digest of the base spans, all spans, of every row."""
    found = cut(with_spans(docs, key=key, text=text).drop("row").withColumn("_row", F.monotonically_increasing_id()))
    rows = with_terms(found.where(F.col("node").isNotNull()), docs, text, **how).select("doc_id", "spans", "extra", "every")
    none = F.array().cast(SPAN)
    rows = rows.unionByName(found.where(F.size("spans") == 0).select("doc_id", "spans", none.alias("extra"), none.alias("every")))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), F.size("extra").cast("long").alias("n_term"), F.size("every").cast("long").alias("n_spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays; its spans are masked."""
    columns = docs.columns
    whole = F.coalesce(F.col("text"), F.lit(""))
    found = with_spans(docs, carry=F.struct(*[F.col(c) for c in columns])).where(F.size("spans") > 0)
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    rows = with_terms(found, docs, "text").withColumn("clean", sanitised(F.col("text"), F.col("every")))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(dict(docs.dtypes).get("n_chars", "long"))}
    changed = rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns])
    return docs.where(F.size(base_spans(whole)) == 0).unionByName(changed)
