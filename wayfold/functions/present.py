"""Texts, links and keys made of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.density import mapping_density
from wayfold.functions.geo import let, scaled_digits
from wayfold.functions.seasonal import trim

# Labels that readers see.
UNNAMED = {"dog_park": "Unnamed dog park", "bathing_spot": "Unnamed bathing spot"}
PROVENANCE_LABELS = {"designated": "Dog bathing area", "permitted": "Dogs allowed", "name-match": "Unverified — matched by name"}
EMPTY_DETAILS = {
    "sparse": "Few dog parks are mapped in this part of the world. There may well be one nearby that nobody has added to OpenStreetMap yet.",
    "dense": "OpenStreetMap has none mapped around here. Its coverage is uneven, so there may be a park that nobody has added yet.",
}
CACHE_PREFIXES = {"dog_park": "dog-parks-v1-", "bathing_spot": "bathing-v1-"}


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)


def fixed(x: Column, decimals: int) -> Column:
    """Text with so many decimals, decided on the exact value of the double."""
    n, scale = scaled_digits(x, decimals).cast("long"), 10**decimals
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), decimals, "0"))


def format_distance(m: Column) -> Column:
    """Metres under 1 km, tenths of a km under 10 km, whole km from there."""
    km = m / 1000
    return F.when(m < 1000, F.concat(half_up(m).cast("string"), F.lit(" m"))).when(km >= 10, F.concat(half_up(km).cast("string"), F.lit(" km"))).otherwise(F.concat(fixed(km, 1), F.lit(" km")))


def spot_label(name: Column, kind: Column) -> Column:
    plain = F.when(kind == "dog_park", UNNAMED["dog_park"]).when(kind == "bathing_spot", UNNAMED["bathing_spot"])
    return F.when(name.isNotNull() & (trim(name) != ""), name).otherwise(plain)


def describe_tags(tags: Column) -> Column:
    """Known facts in fixed order, parted by a middle dot; unknown ones left out."""
    yes_no = lambda c, a, b: F.when(c, a).when(~c, b)
    return F.concat_ws(
        " · ",
        yes_no(tags["leash_required"], "Leash required", "Off-leash OK"),
        yes_no(tags["fenced"], "Fenced", "Not fenced"),
        yes_no(tags["lit"], "Lit", "Not lit"),
        F.concat(F.lit("Surface: "), F.replace(tags["surface"], F.lit("_"), F.lit(" "))),
    )


def provenance_label(grade: Column, kind: Column) -> Column:
    """Bathing spots only."""
    out = F.lit(None).cast("string")
    for key, label in PROVENANCE_LABELS.items():
        out = F.when(grade == key, label).otherwise(out)
    return F.when(kind == "bathing_spot", out)


def pair(lat: Column, lon: Column) -> Column:
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def directions_url(to: Column, origin: Column, agent: Column) -> Column:
    """A maps link by platform. ``to`` and ``origin`` are "lat,lon"; origin may be null."""
    apple = F.concat(F.lit("https://maps.apple.com/?daddr="), to, F.coalesce(F.concat(F.lit("&saddr="), origin), F.lit("")))
    web = F.concat(F.lit("https://www.google.com/maps/dir/?api=1&destination="), to, F.coalesce(F.concat(F.lit("&origin="), origin), F.lit("")))
    return F.when(agent.rlike("iPad|iPhone|iPod"), apple).when(agent.contains("Android") & origin.isNull(), F.concat(F.lit("geo:"), to, F.lit("?q="), to)).otherwise(web)


def _three_decimals(x: Column) -> Column:
    n = half_up(x * 1000)
    sign = F.when(n < 0, "-").otherwise("")
    a = F.abs(n)
    return F.concat(sign, F.floor(a / 1000).cast("string"), F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0"))


def cache_key(kind: Column, lat: Column, lon: Column, radius_m: Column) -> Column:
    """The remembered answers' key: layer, position to three decimals, whole radius."""
    prefix = F.when(kind == "dog_park", CACHE_PREFIXES["dog_park"]).otherwise(CACHE_PREFIXES["bathing_spot"])
    return F.concat(prefix, _three_decimals(lat), F.lit(","), _three_decimals(lon), F.lit(","), half_up(radius_m).cast("string"))


def empty_message(radius_m: Column, lat: str, lon: str) -> Column:
    """struct<title, detail> of an answer without places; wording depends on the mapping
    density at the columns lat and lon."""
    within = F.concat(F.lit(" within "), format_distance(radius_m))
    said = lambda sparse: F.struct(F.concat(F.when(sparse, "No dog parks mapped").otherwise("No dog parks"), within).alias("title"), F.when(sparse, EMPTY_DETAILS["sparse"]).otherwise(EMPTY_DETAILS["dense"]).alias("detail"))
    return let(mapping_density(lat, lon) == "sparse", said)


def format_delta(ms: Column) -> Column:
    n = half_up(ms)
    return F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"))


def accuracy_text(m: Column) -> Column:
    """Plus or minus whole metres; null for unknown or non-finite accuracy."""
    return F.when(m.isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), F.concat(F.lit("±"), half_up(m).cast("string"), F.lit(" m")))


def layer_note(state: Column, count: Column, nearest_m: Column, radius_m: Column, has_stale: Column) -> Column:
    """struct<text, retry, invite> of the bathing layer: off, loading, ready or failed."""
    some = F.concat(F.when(count == 1, "1 bathing spot").otherwise(F.concat(count.cast("string"), F.lit(" bathing spots"))), F.when(nearest_m < 1000, "").otherwise(F.concat(F.lit(", nearest "), format_distance(nearest_m))), F.lit("."))
    ready = F.when(count == 0, F.concat(F.lit("No bathing spots within "), format_distance(radius_m), F.lit("."))).otherwise(some)
    text = F.when(state == "loading", "Looking for bathing spots…").when(state == "ready", ready).when((state == "failed") & has_stale, "These bathing spots may be out of date.").when(state == "failed", "Couldn’t load bathing spots.")
    return F.struct(text.alias("text"), (state == "failed").alias("retry"), ((state == "ready") & ((count == 0) | F.coalesce(nearest_m > 3000, F.lit(False)))).alias("invite"))
