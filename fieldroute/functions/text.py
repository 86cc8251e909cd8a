"""Cleansing Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

#: Words that stand for a missing value, names of one country, words for true and false.
NULL_WORDS = ("nan", "None", "none", "NaN", "NAN", "NaT", "nat")
COUNTRY_NAMES = ("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA")
#: Other names of the routing modes.
MODE_ALIASES = {
    "vrp": "na_general",
    "smart_routing": "na_general",
    "smart-routing": "na_general",
    "north_america_general": "na_general",
    "north-america-general": "na_general",
    "weekday": "weekday_general",
    "z-weekday": "z_weekday",
    "z-weekend": "z_weekend",
}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "y", "yes", "t"), ("false", "0", "f", "n", "no", "")


def collapse(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def blank_null_words(c):
    return F.when(c.isin(*NULL_WORDS), "").otherwise(c)


def country(c):
    name = F.upper(collapse(c))
    return F.when(name.isin(*COUNTRY_NAMES), "USA").otherwise(name)


def postal_key(c):
    """Upper-cased text before a dash, as a whole number where it is a number; leading zeros and decimals go."""
    head = F.regexp_replace(F.upper(F.split(collapse(c), "-")[0]), r"\.0+$", "")
    whole = F.when(head.rlike(r"^[0-9]+$"), head.try_cast("bigint"))
    number = F.when(head.rlike(r"^[+]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$"), head.try_cast("double").try_cast("bigint"))
    return F.coalesce(F.coalesce(whole, number).cast("string"), head)


def postal_padded(c):
    return F.when(F.length(c) >= 5, c).otherwise(F.lpad(c, 5, "0"))


def address_key(*parts):
    return F.concat_ws("|", *[F.upper(collapse(p)) for p in parts])


def boolean(c):
    word = F.lower(F.trim(c))
    return F.when(c.isNull() | word.isin(*FALSE_WORDS), False).otherwise(True)


def slug(c):
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def digits_date(c):
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 8, digits).otherwise("")


def first_nonblank(*columns):
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def any_nonblank(*columns):
    return reduce(lambda a, b: a | b, [F.trim(F.coalesce(c, F.lit(""))) != "" for c in columns])


def clock_minutes(c, fallback: int):
    """Minutes of a strict HH:MM."""
    ok = c.rlike(r"^[0-2][0-9]:[0-5][0-9]$")
    return F.when(ok, F.substring(c, 1, 2).try_cast("int") * 60 + F.substring(c, 4, 2).try_cast("int")).otherwise(F.lit(fallback))


def clock_text(minutes):
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def street(line, city, state, postal, country_name):
    """A street line without the place names written after it, in any number and either case.

    Those are city, state, code and country; city, state and code; state and code; the country.
    A form with a blank part is left out.
    """
    parts = [F.nullif(collapse(c), F.lit("")) for c in (city, state, postal, country_name)]
    # Quoted as they are; the mark that ends a quotation is taken out of it.
    quoted = [F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")) for p in parts]
    gap, pause = F.lit(r"[\s,]+"), F.lit(r"[\s,]*")
    town, region, code, land = quoted
    forms = F.concat_ws("|", F.concat(town, gap, region, gap, code, gap, land), F.concat(town, gap, region, gap, code), F.concat(region, gap, code), land)
    pattern = F.concat(F.lit("(?i)(?:"), pause, F.lit("(?:"), forms, F.lit("))+"), pause, F.lit("$"))
    whole = collapse(line)
    return F.when(forms == "", whole).otherwise(collapse(F.btrim(F.regexp_replace(whole, pattern, F.lit("")), F.lit(" ,"))))


def coordinate_pair(c):
    """Two doubles from "x,y"; both null unless there are just two and both are numbers."""
    parts = F.split(c, ",")
    x, y = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    both = (F.size(parts) == 2) & x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def day(c):
    """The date of yyyymmdd text, else of ISO text, at midnight; null where it is none."""
    text = F.trim(c)
    return F.coalesce(F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd"))), F.try_to_timestamp(text)).cast("date")


def routing_mode(c, default: str):
    """The mode under its own name; blank ones are the default, unknown ones stay."""
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in MODE_ALIASES.items() for x in pair])
    return F.when(raw == "", default).otherwise(F.coalesce(known[raw], raw))
