"""Seasonal bans from conditional restriction strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import let

#: White space as scripts in browsers know it; Spark's trim() strips plain spaces only.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"

# Month names, their short forms, and the longest each month gets.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_LENGTHS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

RULE_TYPE = "struct<kind:string,from:struct<month:int,day:int>,to:struct<month:int,day:int>>"
# Fixed grammar: a span of days in a conditional value.
_RANGE = rf"^([A-Za-z]+){SPACE}*([0-9]{{1,2}})?{SPACE}*-{SPACE}*([A-Za-z]+){SPACE}*([0-9]{{1,2}})?\z"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def clauses(value: Column) -> Column:
    """Parts between semicolons outside parentheses; a stray ``)`` doesn't count."""
    mark = "\x01"

    def step(a: Column, c: Column) -> Column:
        depth = F.when(c == "(", a["depth"] + 1).when(c == ")", F.greatest(F.lit(0), a["depth"] - 1)).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.concat(a["out"], F.when((c == ";") & (a["depth"] == 0), mark).otherwise(c)).alias("out"))

    # a mark that stands in the text itself must not part clauses
    folded = F.aggregate(_chars(F.replace(value, F.lit(mark), F.lit("\x02"))), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)
    return F.split(folded["out"], mark)


def _unwrap(text: Column) -> Column:
    """Without one pair of parentheses around the whole."""

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        at = a["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), (a["early"] | ((c == ")") & (depth == 0) & (at < F.length(text)))).alias("early"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("early"))
    whole = text.startswith("(") & text.endswith(")") & ~F.aggregate(_chars(text), start, step)["early"]
    return F.when(whole, trim(F.substring(text, F.lit(2), F.greatest(F.lit(0), F.length(text) - 2)))).otherwise(text)


def _month(token: Column) -> Column:
    """1 to 12 for a full or three-letter name in any case, else null."""
    names = {}
    for k, name in enumerate(MONTH_NAMES, 1):
        names |= {name.lower(): k, name[:3].lower(): k}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(token))


def _endpoint(month: Column, day: Column, last: bool) -> Column:
    longest = F.get(F.array(*map(F.lit, MONTH_LENGTHS)), month - 1)
    on = F.when(day == "", longest if last else F.lit(1)).otherwise(F.nullif(day, F.lit("")).try_cast("int"))
    return F.when(on.between(1, longest), F.struct(month.alias("month"), on.alias("day")))


def _ban(clause: Column) -> Column:
    """A ban, or null. Everything before the first @ must be ``no``."""
    at = F.instr(clause, "@")
    head = trim(F.substring(clause, F.lit(1), at - 1))
    when = let(trim(F.substring(clause, at + 1, F.length(clause))), _unwrap)
    part = lambda w, k: F.regexp_extract(w, _RANGE, k)
    ends = let(when, lambda w: F.struct(let(F.struct(_month(part(w, 1)).alias("m"), part(w, 2).alias("d")), lambda x: _endpoint(x["m"], x["d"], False)).alias("from"), let(F.struct(_month(part(w, 3)).alias("m"), part(w, 4).alias("d")), lambda x: _endpoint(x["m"], x["d"], True)).alias("to")))
    rule = let(ends, lambda e: F.when(e["from"].isNotNull() & e["to"].isNotNull(), F.struct(F.lit("ban").alias("kind"), e["from"].alias("from"), e["to"].alias("to")).cast(RULE_TYPE)))
    return F.when((at > 0) & (F.lower(head) == "no"), rule)


def parse_conditional(value: Column) -> Column:
    """The first ban among the clauses, else ``unparsed``; null and empty give null."""
    bans = F.filter(F.transform(clauses(value), _ban), lambda r: r.isNotNull())
    unparsed = F.struct(F.lit("unparsed").alias("kind"), F.lit(None).alias("from"), F.lit(None).alias("to")).cast(RULE_TYPE)
    return F.when(value.isNull() | (value == ""), F.lit(None).cast(RULE_TYPE)).otherwise(F.coalesce(F.get(bans, F.lit(0)), unparsed))


def _ordinal(month_day: Column) -> Column:
    return month_day["month"] * 100 + month_day["day"]


def banned_on(rule: Column, day: Column) -> Column:
    """Whether a ban holds on a date, both ends included, over new year if need be; false
    for unparsed rules, null without a rule."""
    today, start, end = F.month(day) * 100 + F.day(day), _ordinal(rule["from"]), _ordinal(rule["to"])
    holds = F.when(start > end, (today >= start) | (today <= end)).otherwise((today >= start) & (today <= end))
    return F.when(rule["kind"] == "ban", holds).when(rule.isNotNull(), False)


def format_month_day(month_day: Column) -> Column:
    return F.concat(month_day["day"].cast("string"), F.lit(" "), F.get(F.array(*map(F.lit, MONTH_SHORT)), month_day["month"] - 1))


def caption(rule: Column, day: Column) -> Column:
    """struct<text, banned_now> for a bathing spot's rule."""
    window = F.concat(format_month_day(rule["from"]), F.lit(" – "), format_month_day(rule["to"]))
    now = F.coalesce(banned_on(rule, day), F.lit(False))
    text = F.when(rule.isNull(), "Verify signage on site").when(rule["kind"] == "unparsed", "Seasonal rules apply — check signs on site").when(now, F.concat(F.lit("Dogs banned now ("), window, F.lit(")"))).otherwise(F.concat(F.lit("Dogs banned "), window))
    return F.struct(text.alias("text"), now.alias("banned_now"))
