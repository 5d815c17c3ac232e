"""Reading map tags. Every reader takes ``tag``, a function from a key to a string column:
``of_map("tags")`` for a MAP column, ``of_columns({...})`` for promoted flat columns.

Absent is not false: readers give null where the map is silent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tag = Callable[[str], Column]

# The tags that candidates are chosen by.
DOG_PARK = ("leisure", "dog_park")
BATHING_FEATURES = [("leisure", "bathing_place"), ("natural", "beach"), ("leisure", "swimming_area")]
DOGS_ALLOWED = ["yes", "designated"]
NAME_PART = "hundbad"
NAMED_FAMILIES = ["natural", "leisure", "amenity", "man_made", "place"]

PARK, BATHING = "dog_park", "bathing_spot"


def of_map(column: str) -> Tag:
    return lambda key: F.try_element_at(F.col(column), F.lit(key))


def of_columns(columns: dict[str, str]) -> Tag:
    """Flat columns by key; keys without a column read as absent."""
    return lambda key: F.col(columns[key]) if key in columns else F.lit(None).cast("string")


def _is(x: Column, *values: str) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def is_dog_park(tag: Tag) -> Column:
    return _is(tag(DOG_PARK[0]), DOG_PARK[1])


def is_bathing_candidate(tag: Tag) -> Column:
    """A bathing feature that allows dogs, or a named feature of five families whose name
    says so. A family counts by its key alone, whatever the value."""
    feature = F.lit(False)
    for key, value in BATHING_FEATURES:
        feature = feature | _is(tag(key), value)
    family = F.lit(False)
    for key in NAMED_FAMILIES:
        family = family | tag(key).isNotNull()
    named = F.coalesce(F.lower(tag("name")).contains(NAME_PART), F.lit(False))
    return feature & _is(tag("dog"), *DOGS_ALLOWED) | family & named


def is_preselected(tag: Tag) -> Column:
    """The coarse superset: parks, anything with the dog key, and names that hold the name
    part without its first letter, in all-lower or all-upper case only."""
    name = tag("name")
    part = NAME_PART[1:]
    return is_dog_park(tag) | tag("dog").isNotNull() | F.coalesce(name.contains(part) | name.contains(part.upper()), F.lit(False))


def provenance(tag: Tag) -> Column:
    """Grade of a bathing spot; null where dogs are denied."""
    dog = F.coalesce(tag("dog"), F.lit(""))
    return F.when(dog == "designated", "designated").when(dog.isin("yes", "leashed", "unleashed"), "permitted").when(dog == "no", F.lit(None).cast("string")).otherwise("name-match")


def leash_required(tag: Tag) -> Column:
    return F.when(tag("dog") == "leashed", True).when(tag("dog") == "unleashed", False)


def fenced(tag: Tag) -> Column:
    f, b = tag("fenced"), tag("barrier")
    return F.when(f == "yes", True).when(f == "no", False).when(b == "fence", True).when(b == "no", False)


def lit(tag: Tag) -> Column:
    return F.nullif(tag("lit"), F.lit("")) != "no"


def surface(tag: Tag) -> Column:
    return F.nullif(tag("surface"), F.lit(""))


def display_tags(tag: Tag) -> Column:
    return F.struct(leash_required(tag).alias("leash_required"), fenced(tag).alias("fenced"), lit(tag).alias("lit"), surface(tag).alias("surface"))


def adopt_silent(kept: Column, dropped: Column) -> Column:
    """Each field of ``kept``, or of ``dropped`` where ``kept`` is silent; false stays false."""
    return F.struct(*(F.coalesce(kept[f], dropped[f]).alias(f) for f in ("leash_required", "fenced", "lit", "surface")))
