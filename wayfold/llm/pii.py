"""Personal data by regular expressions, checksums and context, on built-in functions only.

Regular expressions propose spans; the Luhn sum and the mod-97 remainder confirm cards
and bank accounts; words near a span raise or lower its score. A span counts when its
score reaches ``THRESHOLD``. What meets the base rules (below) always counts: its score may
be lowered, but not below the threshold.

Base kinds, each leftmost and non-overlapping within its kind: email, ip (parts at most
255), card (14 to 19 digits that pass Luhn), phone (plus sign, 10 to 15 digits). Added
kinds: iban (mod-97), phone_local (ten grouped digits, or 8 to 12 from a zero on, only beside
a telephone word), and national_id (3-2-4 digits, only beside an identity word). A word for
numbered things (order, invoice, serial and so on) lowers a score, so such a number with
both kinds of words near it is left alone.

Null text is empty; an empty text or table gives no spans; repeated rows each get their
own result; extra columns are not read unless asked for. Offsets are code points with an
exclusive end. Unbounded repetitions of the base kinds are possessive, so Java's matcher
neither recurses nor backs off on very long runs; they accept the same strings as the plain
forms. An iban of a country in ``IBAN_LENGTHS`` has that country's length, whatever follows it;
of another country, it is the longest run of whole groups that passes mod-97.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
WINDOW = 40  # characters read before and after a span for context words

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"

#: Characters of a bank account number, by country (the IBAN registry).
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in codes.split()}
_BY_LENGTH = "|".join(rf"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values())))

#: Words that speak against a number being personal: it numbers a thing.
_THINGS = "order|invoice|ticket|serial|isbn|version|model|item|batch|page"
#: kind, in order among equal starts: pattern, cheap test of the text, base score, words that
#: raise it and words that lower it (whole words, also with an s)
KINDS = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", 0.9, "e-?mail|mail|contact|write", "example|sample"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login", "version|release|section"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|amex|pay|payment", _THINGS),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "(?:tele)?phone|tel|call|fax|mobile", _THINGS),
    ("iban", rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|[A-Z]{{2}}[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])", None, 0.75, "iban|account|bank|bic", _THINGS),
    ("phone_local", r"(?<![0-9+(])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}[\x20/-][0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3})(?![0-9])", None, 0.3, "(?:tele)?phone|tel|call|fax|mobile", _THINGS),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security|identity|passport", _THINGS),
]
BASE = ("email", "ip", "card", "phone")
ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}


def _mod97(text: Column) -> Column:
    """Remainder of a bank account number: first four characters last, letters as 10 to 35."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def digit(rest: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), digit)


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "phone_local":
        return F.length(digits).between(8, 12)
    if kind == "iban":
        length = F.length(F.replace(hit, F.lit(" "), F.lit("")))
        own = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.left(hit, F.lit(2)))
        return length.between(15, 34) & F.coalesce(length == own, F.lit(True)) & (_mod97(hit) == 1)
    return F.lit(True)


def _longest_valid(kind: str, hit: Column) -> Column:
    """The longest run of the hit's groups, from the first on, that is valid; else null."""
    groups = F.split(hit, " ")
    ends = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    return F.get(F.filter(ends, lambda x: _valid(kind, x)), F.lit(0))


def _may_have(kind: str, text: Column, sign: str | None) -> Column:
    if kind == "iban":
        return text.rlike("[A-Z]{2}[0-9]{2}")
    if kind in ("card", "phone_local", "national_id"):
        return text.rlike("[0-9]{2}|[0-9][ -][0-9]") if kind == "card" else text.rlike("[0-9]{2}[) ./-]")
    return text.contains(sign)


def _starts(parts: Column, hits: Column) -> Column:
    """Offsets of the hits from the lengths of what lies between them, in two levels so
    that a text with very many hits stays far from quadratic work."""
    step = 256
    gaps = F.transform(hits, lambda h, i: F.length(F.get(parts, i)))
    ends = F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("len"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(hits) - 1) / step).cast("int"))), lambda b: F.slice(ends, b * step + 1, step))

    def run(block: Column, base: Column) -> Column:
        nothing = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, nothing, lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"]).alias("out")))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    whole = F.aggregate(blocks, nothing, lambda a, b: F.transform(F.array(run(b, a["at"])), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))[0])
    return F.flatten(whole["out"])


def _score(kind: str, words: str, against: str, start: float, text: Column, at: Column, end: Column) -> Column:
    near = F.lower(F.concat(F.substr(text, F.greatest(F.lit(1), at + 1 - WINDOW), F.least(at, F.lit(WINDOW))), F.lit(" "), F.substr(text, end + 1, F.lit(WINDOW))))
    score = F.lit(start) + F.when(near.rlike(rf"\b(?:{words})s?\b"), 0.25).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{against})s?\b"), 0.25).otherwise(0.0)
    return F.greatest(score, F.lit(THRESHOLD)) if kind in BASE else score


def _unused(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with."""
    prefix = "__pii_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def with_spans(df: DataFrame, text: str = "text", to: str = "pii_spans") -> DataFrame:
    """Add ``to``: array<struct<start int, end int, kind string, kind_no int, score double>>,
    ordered by start, then kind as listed. All other columns stay as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    mine = _unused(df)
    hits, parts = {}, {}
    for kind, pattern, sign, *_ in KINDS:
        hits[f"{mine}hits_{kind}"] = F.when(_may_have(kind, body, sign), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = df.withColumns(hits)
    for kind, pattern, *_ in KINDS:
        parts[f"{mine}parts_{kind}"] = F.when(F.size(f"{mine}hits_{kind}") > 0, F.split(body, pattern, -1)).otherwise(F.array().cast("array<string>"))
    found = found.withColumns(parts)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,kind_no:int,score:double>>")

    def spans(kind: str, start: float, words: str, against: str) -> Column:
        h = F.col(f"{mine}hits_{kind}")
        both = F.arrays_zip(h.alias("hit"), _starts(F.col(f"{mine}parts_{kind}"), h).alias("at"))
        if kind == "iban":
            both = F.transform(both, lambda x: F.struct(_longest_valid(kind, x["hit"]).alias("hit"), x["at"].alias("at")))
            both = F.filter(both, lambda x: x["hit"].isNotNull())
        else:
            both = F.filter(both, lambda x: _valid(kind, x["hit"]))
        made = F.transform(both, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), F.lit(ORDER[kind]).alias("kind_no"), _score(kind, words, against, start, body, x["at"], x["at"] + F.length(x["hit"])).alias("score")))
        return F.when(F.size(h) > 0, F.filter(made, lambda s: s["score"] >= THRESHOLD)).otherwise(empty)

    whole = F.concat(*(spans(kind, start, words, against) for kind, _, _, start, words, against in KINDS))
    by_start = F.array_sort(F.transform(whole, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))))
    out = found.withColumn(to, F.transform(by_start, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["kind_no"].alias("kind_no"), s["score"].alias("score"))))
    return out.drop(*hits, *parts)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets; overlapping spans become one.

    Texts without spans, null ones included, stay as they are; so do all other columns
    but ``n_chars``, which follows the text where it is present."""
    spans, fold = f"{_unused(df)}spans", f"{_unused(df)}fold"
    marked = with_spans(df, text, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        piece = F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(piece).alias("out"))

    folded = F.aggregate(F.col(spans), start, step)
    done = marked.withColumn(fold, F.when(F.size(spans) > 0, folded))
    new = F.when(F.col(fold).isNull(), F.col(text)).otherwise(F.concat(F.col(f"{fold}.out"), F.substr(F.col(text), F.col(f"{fold}.at") + 1)))
    done = done.withColumn(text, new)
    if "n_chars" in df.columns:
        done = done.withColumn("n_chars", F.when(F.col(fold).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return done.select(*df.columns)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, and all spans as text."""

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = with_spans(df.select("doc_id", "text"))
    spans = F.col("pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind_no"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
