"""Numbers, amounts, units, dates, keys and text quality as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit factors.
HA_TO_AC, HA_TO_AC_PRINTED, CENT_AC, CENT_SQM = 2.47105, 2.47, 0.01, 40.4686
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def clean(text: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.trim(F.coalesce(text, F.lit("")))


def number(text: Column) -> Column:
    """A plain decimal, or null."""
    bare = F.regexp_replace(text, r"[\s,]", "")
    return F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.cast("double"))


#: Words for hectares and acres in cells.
UNIT_WORDS = r"(?i)(ஹெக்டேர்|ஹெக்டர்|ஹெக்\.?|hectares?|hect\.?|hec\.?|ha\.?|ஏக்கர்|ஏக்\.?|acres?|ac\.?|\(|\))"


def extent_ha(text: Column) -> Column:
    """Hectares of H.AA.SS (a last single digit counts as tens), H-AA.SS, 0AA.SS whose first dot is lost, or a plain decimal; four digits.

    What follows a bracket is left out if digits stand before it; unit words, commas and blanks don't count."""
    raw = tamil_digits(clean(text))
    ahead = F.substring_index(raw, "(", 1)
    cell = F.regexp_replace(F.when(ahead.rlike("[0-9]"), ahead).otherwise(raw), UNIT_WORDS, " ")
    cell = F.regexp_replace(F.translate(F.regexp_replace(cell, r"[,\s]", ""), ":–—", ".--"), "^[.-]+|[.-]+$", "")
    triple, dash, lost = r"^(\d+)\.(\d{1,2})\.(\d{1,2})$", r"^(\d+)-(\d{1,2}(?:\.\d{1,2})?)$", r"^0(\d{2})\.(\d{2})$"
    part = lambda p, i: F.regexp_extract(cell, p, i).try_cast("double")
    last = F.rpad(F.regexp_extract(cell, triple, 3), 2, "0").try_cast("double")
    return (
        F.when(cell.rlike(triple), F.round(part(triple, 1) + part(triple, 2) / 100 + last / 10000, 4)).when(cell.rlike(dash), F.round(part(dash, 1) + part(dash, 2) / 100, 4))
        .when(cell.rlike(lost), F.round(part(lost, 1) / 100 + part(lost, 2) / 10000, 4)).when(cell.rlike(r"^\d+(\.\d+)?$"), F.round(cell.try_cast("double"), 4))
    )


def extent_ac(text: Column) -> Column:
    """Acres as a plain decimal, unit words left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(tamil_digits(clean(text)), UNIT_WORDS, " "), r"[,\s]", ""), r"^\.+|\.+$", "")
    return F.when(bare.rlike(r"^\d+(\.\d+)?$"), F.round(bare.try_cast("double"), 4))


def cents(text: Column) -> Column:
    """Cents as a plain number; halves and quarters may be one character."""
    raw = F.replace(F.replace(F.replace(tamil_digits(clean(text)), F.lit("½"), F.lit(".5")), F.lit("¼"), F.lit(".25")), F.lit("¾"), F.lit(".75"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)(சென்ட்|செண்ட்|cents?)", ""), r"\s", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\.", "0."), r"^(\d+)\.\.", "$1.")
    return F.when(bare.rlike(r"^\d+(\.\d+)?$"), F.round(bare.try_cast("double"), 4))


def ha_to_ac(ha: Column) -> Column:
    return F.round(ha * HA_TO_AC, 4)


def ac_to_ha(ac: Column) -> Column:
    return F.round(ac / HA_TO_AC, 4)


def cents_to_ha(cents: Column) -> Column:
    return F.round(cents * CENT_SQM / 10000, 4)


def extents_agree(ha: Column, ac: Column) -> Column:
    """Whether two readings agree by either factor: within 0.02 acres, or 0.1 % above 10 ha; null if either is missing."""
    tolerance = F.when(ha > 10, F.greatest(F.lit(0.02), ha * HA_TO_AC * 0.001)).otherwise(0.02) + 1e-9
    near = (F.abs(ha * HA_TO_AC - ac) <= tolerance) | (F.abs(ha * HA_TO_AC_PRINTED - ac) <= tolerance)
    return F.when(ha.isNotNull() & ac.isNotNull(), near)


#: Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "million": 1_000_000, "crore": 10_000_000, "crores": 10_000_000}


def number_words(text: Column) -> Column:
    """Number that English words give ("twelve lakh sixty thousand"); other words don't count; null without a number word."""
    ones = {w: i for i, w in enumerate(UNITS)} | TENS
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*ones, *SCALES, "hundred"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("now"))

    def step(a: Column, w: Column) -> Column:
        unit, scale = F.try_element_at(table(ones), w).cast("long"), F.try_element_at(table(SCALES), w).cast("long")
        now = F.greatest(a["now"], F.lit(1).cast("long"))
        pair = lambda x, y: F.struct(x.alias("sum"), y.alias("now"))
        return F.when(unit.isNotNull(), pair(a["sum"], a["now"] + unit)).when(w == "hundred", pair(a["sum"], now * 100)).otherwise(pair(a["sum"] + now * scale, F.lit(0).cast("long")))

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda a: a["sum"] + a["now"]))


def amount(text: Column) -> Column:
    """Whole rupees: the longest run of digits with commas or dots (the first on a tie). Of several dots, a last group of two digits is paise and the
    others group thousands. Without a digit, number words are read."""
    bare = F.regexp_replace(tamil_digits(clean(text)), " ", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"\d[\d,.]*\d|\d"), F.lit(0))
    longest = F.reduce(tokens, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    dots = F.length(longest) - F.length(F.replace(longest, F.lit("."), F.lit("")))
    last = F.substring_index(longest, ".", -1)
    plain = F.when(dots <= 1, longest).when(F.length(last) == 2, F.replace(F.regexp_replace(longest, r"\.\d\d$", ""), F.lit("."), F.lit(""))).otherwise(F.replace(longest, F.lit("."), F.lit("")))
    return F.when(F.size(tokens) > 0, F.floor(F.replace(plain, F.lit(","), F.lit("")).try_cast("double")).cast("long")).otherwise(number_words(text))


def compensation_matches(paid: Column, extent: Column, rate: Column, tolerance: float = 1.0, share: float = 0.005) -> Column:
    return F.abs(paid - extent * rate) <= F.greatest(F.lit(tolerance), share * F.abs(extent * rate))


def parse_date(text: Column) -> Column:
    """struct(value, precision): d/m/y in digits, day month year or month year in words, a year alone (2020 to 2026)."""
    low = F.lower(clean(text))
    digits = r"\b(\d{1,2})[./-](\d{1,2})[./-](20\d{2})\b"
    d, m, y = (F.regexp_extract(low, digits, i).try_cast("int") for i in (1, 2, 3))
    full = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    names = "|".join(MONTHS)
    worded = rf"\b(?:(\d{{1,2}})\s+)?({names})\s+(20\d{{2}})\b"
    wd, wy = F.regexp_extract(low, worded, 1).try_cast("int"), F.regexp_extract(low, worded, 3).try_cast("int")
    wm = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.regexp_extract(low, worded, 2)).cast("int")
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", wy, wm, wd), "yyyy-MM-dd")
    month = F.try_to_date(F.format_string("%04d-%02d-01", wy, wm), "yyyy-MM-dd")
    year = F.regexp_extract(low, r"\b(202[0-6])\b", 1)
    none = F.lit(None).cast("date")
    value = F.when(full.isNotNull(), full).when(day.isNotNull(), day).when(month.isNotNull(), month).when(year != "", F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd")).otherwise(none)
    precision = F.when(full.isNotNull() | day.isNotNull(), "day").when(month.isNotNull(), "month").when(year != "", "year")
    return F.struct(value.alias("value"), precision.alias("precision"))


def find_dates(text: Column) -> Column:
    """All d/m/y dates of a text, in order; impossible ones left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b\d{1,2}[./-]\d{1,2}[./-]20\d{2}\b"), F.lit(0))
    as_date = lambda t: F.coalesce(F.try_to_date(F.regexp_replace(t, "[.-]", "/"), "d/M/yyyy"), F.lit(None).cast("date"))
    return F.filter(F.transform(found, as_date), lambda d: d.isNotNull())


def survey_ref(text: Column) -> Column:
    """struct(survey, subdivision): 'No. 12/3A' gives 12 and 3A; subdivision null if none."""
    low = F.upper(F.regexp_replace(clean(text), r"(?i)^(s\.?\s*f\.?|survey)?\s*no\.?\s*:?\s*", ""))
    pattern = r"^(\d+)\s*(?:[/-]\s*([0-9A-Z]+))?"
    sub = F.regexp_extract(low, pattern, 2)
    return F.struct(F.when(F.regexp_extract(low, pattern, 1) != "", F.regexp_extract(low, pattern, 1)).alias("survey"), F.when(sub != "", sub).alias("subdivision"))


#: Tamil digits, and letters of subdivisions.
TAMIL_DIGITS, TAMIL_LETTERS = "௦௧௨௩௪௫௬௭௮௯", "அஆஇஈஉஊ"


def tamil_digits(text: Column) -> Column:
    """Tamil digits as ASCII digits; all else stays."""
    return F.translate(text, TAMIL_DIGITS, "0123456789")


def norm_token(text: Column) -> Column:
    """Upper case, only letters, digits and inner slashes, without what stands in parentheses, and without leading zeros of a number; null is empty."""
    plain = F.translate(tamil_digits(F.coalesce(text, F.lit(""))), TAMIL_LETTERS, "ABCDEF")
    bare = F.regexp_replace(F.upper(F.regexp_replace(plain, r"\(.*?\)", "")), "[^0-9A-Z/]", "")
    return F.regexp_replace(F.regexp_replace(bare, "^/+|/+$", ""), "(^|/)0+(?=[0-9])", "$1")


def parse_refs(survey: Column, subdivision: Column) -> Column:
    """array of distinct (survey, sub) that a record's two fields name, in order; sub is empty for a whole survey.

    Items are parted by commas, semicolons, 'and', '&'; one with a slash names its own survey, others belong to the last one named."""
    whole = norm_token(survey)
    head, tail = F.substring_index(whole, "/", 1), F.when(F.contains(whole, F.lit("/")), F.regexp_replace(whole, "^[^/]*/", "")).otherwise(F.lit(""))
    joined = F.concat_ws(",", F.when(tail != "", tail), F.regexp_replace(F.coalesce(subdivision, F.lit("")), r"மற்றும்|&|\band\b", ","))
    items = F.filter(F.transform(F.split(joined, "[,;]"), norm_token), lambda t: t != "")
    ref = lambda s, d: F.struct(s.alias("survey"), d.alias("sub"))
    empty = F.struct(head.alias("now"), F.array().cast("array<struct<survey:string,sub:string>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        own = F.contains(t, F.lit("/"))
        s = F.when(own, F.substring_index(t, "/", 1)).otherwise(a["now"])
        d = F.when(own, F.regexp_replace(t, "^[^/]*/", "")).otherwise(t)
        return F.struct(s.alias("now"), F.array_append(a["out"], ref(s, d)).alias("out"))

    found = F.array_distinct(F.filter(F.aggregate(items, empty, step, lambda a: a["out"]), lambda r: r["survey"] != ""))
    alone = F.when(head != "", F.array(ref(head, F.lit("")))).otherwise(F.array().cast("array<struct<survey:string,sub:string>>"))
    return F.when(F.size(items) == 0, alone).otherwise(found)


#: Pairs of characters that scans mix up.
CONFUSABLE = (("3", "8"), ("1", "7"), ("0", "6"), ("5", "6"), ("A", "4"))


def ocr_variants(token: Column, swaps: int = 2) -> Column:
    """struct(variant, swaps) of every way of exchanging up to so many confusable characters (the token itself: 0)."""
    others: dict[str, str] = {}
    for a, b in CONFUSABLE:
        others[a], others[b] = others.get(a, "") + b, others.get(b, "") + a
    start = F.array(F.struct(F.lit("").alias("variant"), F.lit(0).alias("swaps")))
    table = F.create_map(*[F.lit(x) for pair in others.items() for x in pair])

    def step(found: Column, c: Column) -> Column:
        same = F.transform(found, lambda v: F.struct(F.concat(v["variant"], c).alias("variant"), v["swaps"].alias("swaps")))
        other = F.filter(F.split(F.coalesce(F.try_element_at(table, c), F.lit("")), ""), lambda x: x != "")
        open_ = F.filter(found, lambda v: v["swaps"] < swaps)
        swapped = F.flatten(F.transform(open_, lambda v: F.transform(other, lambda x: F.struct(F.concat(v["variant"], x).alias("variant"), (v["swaps"] + 1).alias("swaps")))))
        return F.concat(same, swapped)

    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step)


def text_quality(text: Column, good: str, known: Sequence[str]) -> Column:
    """0.6 times the share of good characters and 0.4 times that of known words; 0 for blank text."""
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    bare = F.length(F.regexp_replace(whole, r"\s+", ""))
    fine = F.length(F.regexp_replace(whole, rf"[^{good}]+", "")) / bare
    words = F.regexp_count(low, F.lit("[a-z]+"))
    hits = F.regexp_count(low, F.lit(rf"(?<![a-z])(?:{'|'.join(known)})(?![a-z])"))
    share = F.when(words > 0, hits / words).otherwise(0.0)
    return F.when(bare > 0, 0.6 * fine + 0.4 * share).otherwise(0.0)


def character_error(reference: Column, read: Column) -> Column:
    return F.when(F.length(reference) > 0, F.levenshtein(reference, read) / F.length(reference)).otherwise(F.when(F.length(read) > 0, 1.0).otherwise(0.0))


def pseudonym(key: Column, salt: str, prefix: str = "OWNER-") -> Column:
    """prefix and the first ten hex digits of md5(salt:key)."""
    return F.when(key.isNotNull(), F.concat(F.lit(prefix), F.substring(F.md5(F.concat(F.lit(salt + ":"), key)), 1, 10)))


def mask_numbers(text: Column, least: int = 9) -> Column:
    """Runs of at least so many digits replaced, as account numbers are."""
    return F.regexp_replace(text, rf"\d{{{least},}}", "[number]")


def mask_mail(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[mail]")


def reflectance(dn: Column, offset: Column) -> Column:
    """Reflectance of a raw value; 0 is no data."""
    return F.when(dn != 0, (dn + offset) * 1e-4)


def ratio_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), kept from dividing by nothing."""
    return (a - b) / (a + b + 1e-6)


def simplify_tolerance(zoom: Column) -> Column:
    return F.round(0.2 / F.pow(F.lit(2.0), zoom), 8)


def json_number(text: Column, path: str) -> Column:
    """A number out of JSON text, or null."""
    return F.get_json_object(text, path).try_cast("double")
