"""Expressions over a place's tag map: names, categories, hours and fees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import CATEGORY_RULES, EXCLUDED_NAMES, KEPT_TAGS

_RANGE = r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})"


def tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def pick_name(tags: Column) -> Column:
    """The first of four name tags with three characters at least, trimmed."""
    return F.coalesce(*(F.when(F.length(F.trim(tag(tags, k))) >= 3, F.trim(tag(tags, k))) for k in ("name:en", "name", "int_name", "official_name")))


def excluded_name(name: Column) -> Column:
    return name.rlike(EXCLUDED_NAMES)


def categorise(tags: Column) -> Column:
    """The first rule that hits and, where it asks for one, has a corroborating tag."""

    def rule(category, hits, needs):
        hit = reduce(lambda a, b: a | b, (F.coalesce(tag(tags, k).isin(v), F.lit(False)) for k, v in hits))
        if needs:
            hit = hit & reduce(lambda a, b: a | b, (F.coalesce(tag(tags, k) != "", F.lit(False)) for k in needs))
        return F.when(hit, F.lit(category))

    return F.coalesce(*(rule(*r) for r in CATEGORY_RULES))


def opening_hours(text: Column) -> Column:
    """struct(open_min, close_min): the widest window of all ranges, null when none can be read.

    A range that ends before it starts crosses midnight; closing is capped at
    midnight.
    """
    t = F.lower(F.trim(text))
    part = lambda g: F.regexp_extract_all(t, F.lit(_RANGE), F.lit(g))
    ranges = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))
    minutes = lambda h, m: h.cast("int") * 60 + m.cast("int")
    both = F.transform(ranges, lambda r: F.struct(minutes(r["a"], r["b"]).alias("o"), minutes(r["c"], r["d"]).alias("c")))
    both = F.transform(both, lambda r: F.struct(r["o"].alias("o"), F.when(r["c"] <= r["o"], r["c"] + 1440).otherwise(r["c"]).alias("c")))
    both = F.filter(both, lambda r: (r["o"] <= 1440) & (r["c"] <= 2880))
    window = F.struct(F.array_min(F.transform(both, lambda r: r["o"])).alias("open_min"), F.array_max(F.transform(both, lambda r: F.least(r["c"], F.lit(1440)))).alias("close_min"))
    always = F.struct(F.lit(0).alias("open_min"), F.lit(1440).alias("close_min"))
    return F.when(t.isin("24/7", "24 hours", "24hrs"), always).when(F.size(both) > 0, window)


def parse_fee(tags: Column) -> Column:
    """Fee in rupees: the first number of the charge, dollars at 300; 0 for a fee of no; else null."""
    charge = F.coalesce(F.when(tag(tags, "charge") != "", tag(tags, "charge")), F.when(tag(tags, "fee:amount") != "", tag(tags, "fee:amount")))
    amount = F.regexp_replace(F.regexp_extract(charge, r"(\d[\d,\.]*)", 1), ",", "").try_cast("double")
    amount = F.when(F.lower(charge).contains("usd"), amount * 300).otherwise(amount)
    return F.coalesce(amount, F.when(F.lower(tag(tags, "fee")).isin("no", "false"), F.lit(0.0)))


def kept_tags(tags: Column) -> Column:
    """The kept tags as a JSON object, keys in order."""
    pairs = F.array_sort(F.map_entries(F.map_filter(tags, lambda k, v: k.isin(KEPT_TAGS))))
    return F.to_json(F.map_from_entries(pairs))


def unesco(tags: Column) -> Column:
    return F.coalesce(tag(tags, "heritage:operator") == "whc", F.lit(False)) | F.coalesce(F.lower(tag(tags, "heritage:website")).contains("world heritage"), F.lit(False))


def normalise_name(name: Column) -> Column:
    """Latin tokens of a name, lower-cased."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(normalise_name(name), " "), lambda x: x != "")), " ")


def wiki_title(text: Column) -> Column:
    """English page title of a language-prefixed tag; null for other languages."""
    lang = F.split_part(text, F.lit(":"), F.lit(1))
    after = F.substr(text, F.length(lang) + 2)
    title = F.when(text.contains(":"), F.when(F.lower(F.trim(lang)) == "en", F.trim(after))).otherwise(F.trim(text))
    return F.when(text != "", F.regexp_replace(title, " ", "_"))
