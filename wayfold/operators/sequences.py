"""Ordered events: deltas, first marks, movement, latest questions, remembered answers,
publish gates, gazetteer look-ups, rate gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions.present import half_up, format_delta
from wayfold.operators import scans

# Metres between fixes that ask anew, and how long answers are remembered.
REQUERY_M = 250.0
TTL_MS = 7 * 24 * 60 * 60 * 1000

#: Gate, kind, centre (None: anywhere), metres around it, least count. Fixed values.
GATES = {
    "planet": [
        ("dog parks", "dog_park", None, None, 20_000),
        ("dog parks near Stockholm", "dog_park", (59.3293, 18.0686), 3_000, 20),
        ("dog parks near Berlin", "dog_park", (52.52, 13.405), 50_000, 20),
        ("dog parks near New York", "dog_park", (40.7128, -74.006), 50_000, 20),
        ("dog parks near Sydney", "dog_park", (-33.8688, 151.2093), 50_000, 10),
        ("bathing spots", "bathing_spot", None, None, 40),
    ],
    "europe/sweden": [
        ("dog parks", "dog_park", None, None, 200),
        ("dog parks near Stockholm", "dog_park", (59.3293, 18.0686), 3_000, 20),
        ("bathing spots", "bathing_spot", None, None, 5),
    ],
}


def first_marks(marks: DataFrame, by: str = "session") -> DataFrame:
    """The first mark of each milestone; earlier ``seq`` among equal times."""
    one = marks.groupBy(by, "milestone").agg(F.min(F.struct("at_ms", "seq", "detail")).alias("m"))
    return one.select(by, "milestone", F.col("m.at_ms").alias("at_ms"), F.col("m.detail").alias("detail"))


def step_deltas(marks: DataFrame, by: str = "session", ranges: int | None = None) -> DataFrame:
    """``delta_ms`` to the mark before, the first to zero, and the report's line."""
    out = scans.with_previous(marks, [by], ["at_ms", "milestone"], ["at_ms"], ranges)
    out = out.withColumn("delta_ms", F.col("at_ms") - F.coalesce("__previous.at_ms", F.lit(0.0))).drop("__previous")
    line = F.concat_ws("\t", "milestone", F.concat(half_up(F.col("at_ms")).cast("string"), F.lit("ms")), F.concat(F.lit("("), format_delta(F.col("delta_ms")), F.lit("ms)")), F.nullif(F.col("detail"), F.lit("")))
    return out.withColumn("line", line)


def moves(fixes: DataFrame, by: str = "session", order: tuple[str, ...] = ("ts", "seq"), ranges: int | None = None) -> DataFrame:
    """``moved_m`` since the fix before and ``asks``: at least 250 m, or the first fix."""
    out = scans.with_previous(fixes, [by], order, ["lat", "lon"], ranges)
    moved = geo.haversine_m(F.col("__previous.lat"), F.col("__previous.lon"), F.col("lat"), F.col("lon"))
    return out.withColumn("moved_m", moved).drop("__previous").withColumn("asks", F.coalesce(F.col("moved_m") >= REQUERY_M, F.lit(True)))


def latest_answers(answers: DataFrame, by: tuple[str, ...] = ("session", "layer")) -> DataFrame:
    """Answers to the newest question of each layer; a superseded answer or failure is dropped.

    The newest token is an aggregate joined back, so one busy layer isn't one task."""
    newest = answers.groupBy(*by).agg(F.max("token").alias("token"))
    return answers.join(newest, [*by, "token"], "left_semi")


def fresh(entries: DataFrame, now: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """Entries younger than ``ttl_ms`` and not from the future."""
    age = F.unix_millis(now) - F.unix_millis("stored_at")
    return entries.where((age >= 0) & (age < ttl_ms))


def whole_entries(entries: DataFrame) -> DataFrame:
    """Entries all of whose spots hold what a spot must; one bad spot refuses the entry. A
    season is nothing, unparsed, or a ban between two days of a calendar."""

    def day(d: Column) -> Column:
        return F.coalesce(d["month"].between(1, 12) & d["day"].between(1, 31), F.lit(False))

    def good(s: Column) -> Column:
        season = s["seasonal"].isNull() | F.coalesce(s["seasonal"]["kind"] == "unparsed", F.lit(False)) | (F.coalesce(s["seasonal"]["kind"] == "ban", F.lit(False)) & day(s["seasonal"]["from"]) & day(s["seasonal"]["to"]))
        number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        named = F.coalesce((s["id"] != "") & s["kind"].isin("dog_park", "bathing_spot") & s["provenance"].isin("designated", "permitted", "name-match"), F.lit(False))
        return named & number(s["lat"]) & number(s["lon"]) & s["tags"].isNotNull() & season

    return entries.where(F.coalesce(F.forall("spots", good), F.lit(False)) & F.col("stored_at").isNotNull())


def answer_through_cache(questions: DataFrame, entries: DataFrame, now: Column, ttl_ms: int = TTL_MS) -> DataFrame:
    """``hit`` and remembered ``spots`` of each question by its ``key``; the newest entry counts."""
    good = whole_entries(fresh(entries, now, ttl_ms))
    newest = good.groupBy("key").agg(F.max_by("spots", "stored_at").alias("spots"))
    return questions.join(newest, "key", "left").withColumn("hit", F.col("spots").isNotNull())


def current_prefix(key: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a key starts with one of the prefixes in use."""
    out = F.lit(False)
    for p in prefixes:
        out = out | key.startswith(p)
    return out


def stale_keys(entries: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Keys that start with no current prefix."""
    return entries.where(~current_prefix(F.col("key"), prefixes)).select("key")


def gate_counts(places: DataFrame, region: str) -> DataFrame:
    """gate, n, least, passed in their order: one pass over the places."""
    aggs = []
    for k, (_, kind, at, metres, _) in enumerate(GATES.get(region, [])):
        test = F.col("kind") == kind
        if at:
            test = test & (geo.haversine_m(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lon")) <= metres)
        aggs.append(F.count_if(test).alias(f"g{k}"))
    row = places.agg(F.count(F.lit(1)).alias("all"), *aggs)
    parts = [F.struct(F.lit(0).alias("no"), F.lit("any").alias("gate"), F.col("all").alias("n"), F.lit(1).cast("long").alias("least"))]
    parts += [F.struct(F.lit(k + 1).alias("no"), F.lit(g[0]).alias("gate"), F.col(f"g{k}").alias("n"), F.lit(g[4]).cast("long").alias("least")) for k, g in enumerate(GATES.get(region, []))]
    return row.select(F.explode(F.array(*parts)).alias("g")).select("g.*").withColumn("passed", F.col("n") >= F.col("least"))


def assert_sane(places: DataFrame, region: str, include_rings: int) -> None:
    """Raise at the first gate that fails."""
    rows = sorted(gate_counts(places, region).collect(), key=lambda r: r["no"])
    if not rows[0]["passed"]:
        raise ValueError("no places at all")
    if include_rings < 1:
        raise ValueError("coverage has no include rings")
    for r in rows:
        if not r["passed"]:
            raise ValueError(f"{region}: {r['gate']}: {r['n']}, at least {r['least']} expected")


def kind_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def geocode(gazetteer: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """label, lat, lon of at most five entries whose label holds the text, by importance.

    Coordinates are strings: a blank is no coordinate, never zero."""
    number = lambda c: F.nullif(F.trim(c), F.lit("")).try_cast("double")
    read = gazetteer.select("label", "importance", number("lat").alias("lat"), number("lon").alias("lon"))
    good = (F.coalesce("label", F.lit("")) != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    return read.where(good & F.lower("label").contains(text.lower())).orderBy(F.desc("importance"), "label", "lat", "lon").limit(limit).select("label", "lat", "lon")


def rate_gate(requests: DataFrame, by: str = "client", gap_ms: int = 1000, ranges: int | None = None) -> DataFrame:
    """``go_at_ms``: each request at its time or ``gap_ms`` after the one before, whichever is
    later; a client's requests may lie in any number of tasks."""
    return scans.queued(requests, [by], ["at_ms", "seq"], "at_ms", gap_ms, "go_at_ms", ranges)
