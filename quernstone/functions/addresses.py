"""Address texts and geocoder hits: pure classifications, no network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What kinds of hits are called (fixed values).
HOUSES = ("house", "building", "yes")
STREETS = ("road", "residential", "living_street", "tertiary", "secondary", "primary", "unclassified", "service")
LOCALITIES = ("city", "town", "village", "municipality", "suburb", "neighbourhood", "hamlet", "county", "state", "country", "postcode", "postcode_area", "administrative", "island", "archipelago")
UNIT_NAMES = ("apartment", "apt", "bldg", "building", "fl", "floor", "rm", "room", "ste", "suite", "unit")
#: What a hit's type, or its category, says it is: a house, a street, or a place too large to be an address.
TYPE_SAYS = dict.fromkeys(HOUSES, "house") | dict.fromkeys(STREETS, "street") | dict.fromkeys(LOCALITIES, "area")
CATEGORY_SAYS = {"building": "house", "highway": "street"}


def house_number(address: Column) -> Column:
    """The leading number with its letter, upper case; empty if there is none."""
    return F.upper(F.regexp_extract(address, r"^\s*(\d+[A-Za-z]?)\b", 1))


def without_unit(address: Column) -> Column:
    """The address without apartment, suite and the like; spaces tidied, empty parts left out. One that is nothing else stays as it is.

    A part between commas may end with a unit: a unit's name and its number, ``#`` and a number, or a number behind ``#`` at the
    end of its last word. A unit's number has a digit, letters before it, and letters, digits or hyphens behind.
    """
    is_number = lambda w: F.regexp_like(w, F.lit("^[A-Za-z]*[0-9][-A-Za-z0-9]*$"))
    word = lambda words, k: F.coalesce(F.get(words, F.size(words) - k), F.lit(""))
    named = lambda words: (word(words, 2) == "#") | F.rtrim(F.lower(word(words, 2)), F.lit(".")).isin(*UNIT_NAMES)

    def kept(words: Column) -> Column:
        last = word(words, 1)
        n, behind = F.size(words), F.substring_index(last, "#", -1)
        stem = F.substring(last, F.lit(1), F.length(last) - F.length(behind) - 1)
        return (
            F.when(last.contains("#") & is_number(behind), F.filter(F.concat(F.slice(words, 1, n - 1), F.array(stem)), lambda w: w != ""))
            .when((n >= 2) & named(words) & is_number(last), F.slice(words, 1, F.greatest(n - 2, F.lit(0)))).otherwise(words)
        )

    def part(text: Column) -> Column:
        words = kept(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return F.struct(F.regexp_like(text, F.lit(r"^\s")).alias("spaced"), words.alias("words"))

    parts = F.filter(F.transform(F.split(address, ","), part), lambda p: F.size(p["words"]) > 0)
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(p["spaced"] & (i > 0), " ").otherwise(""), F.array_join(p["words"], " "))), ",")
    return F.when(whole == "", address).otherwise(whole)


def hit_precision(wanted: Column, lat: Column, lon: Column, country: Column, address_type: Column, category: Column, house: Column, shown: Column) -> Column:
    """house, street, or null for a hit that says too little.

    A hit counts if it has a name, lies on the earth and in the country and isn't an area. Its type and its category each may say that
    it is a house or a street; a house must also have the number that was asked for, a building of another number isn't one.
    """
    says = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(F.coalesce(c, F.lit("")))], F.lit(""))
    claims = F.array(says(TYPE_SAYS, address_type), says(CATEGORY_SAYS, category))
    number = house_number(wanted)
    counts = {"name": F.trim(shown) != "", "place": lat.between(-90, 90) & lon.between(-180, 180), "country": F.lower(country) == "us", "address": ~F.array_contains(claims, "area")}
    results = {"house": (number != "") & (number == F.upper(F.coalesce(house, F.lit("")))), "street": F.lit(True)}
    usable = F.forall(F.array(*counts.values()), lambda c: F.coalesce(c, F.lit(False)))
    return F.when(usable, F.coalesce(*[F.when(F.array_contains(claims, k) & more, k) for k, more in results.items()]))


def unique_hits(hits: DataFrame, query: str, precision: str, lat: str, lon: str, order: str) -> DataFrame:
    """The first hit of each query at each precision and place (5 digits)."""
    w = Window.partitionBy(query, precision, F.round(lat, 5), F.round(lon, 5)).orderBy(order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
