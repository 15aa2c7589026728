"""Column builders for street names, house numbers and free-text queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street-type abbreviations and their expansions.
ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue",
    "cres": "crescent", "cr": "crescent", "ct": "court", "crt": "court",
    "dr": "drive", "drv": "drive", "pde": "parade", "par": "parade",
    "gr": "grove", "gve": "grove", "tce": "terrace", "ter": "terrace",
    "pl": "place", "cl": "close", "blvd": "boulevard", "bvd": "boulevard",
    "hwy": "highway", "ln": "lane", "sq": "square", "esp": "esplanade",
    "cct": "circuit", "cir": "circle", "mws": "mews", "rse": "rise",
    "gdns": "gardens", "gdn": "garden", "pkwy": "parkway", "wlk": "walk",
    "gte": "gate", "grn": "green", "hts": "heights", "vw": "view",
}
# Words that say nothing about which street is meant.
NOISE = ("vic", "victoria", "australia", "aus", "au")
# Formats of units and numbers at the start of a query.
UNIT_WORD = r"(?i)^\s*(?:unit|apt|apartment|flat)\s+([0-9]+[a-z]?)\s*,?\s*"
UNIT_SLASH = r"(?i)^\s*(?:(?:unit|apt|apartment|flat|u)\s*)?([0-9]+[a-z]?)\s*/\s*"
NUMBER = r"(?i)^\s*([0-9]+[a-z]?(?:\s*-\s*[0-9]+[a-z]?)?)\s*"
RANGE = r"(?i)^([0-9]+)[a-z]?\s*-\s*([0-9]+)[a-z]?$"
WIDEST_RANGE = 100


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def leading_int(c: Column) -> Column:
    """The digits a string starts with, as a number; null without any."""
    return blank_to_null(F.regexp_extract(c, r"^([0-9]+)", 1)).try_cast("bigint")


def is_postcode(token: Column) -> Column:
    return token.rlike("^[0-9]{4}$")


def street_tokens(street: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(street), "[^a-z0-9 ]+", " ")), " +")
    useful = F.filter(words, lambda t: (t != "") & ~t.isin(*NOISE) & ~is_postcode(t))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.transform(useful, lambda t: F.coalesce(F.try_element_at(table, t), t))


def normalise_street(street: Column) -> Column:
    """Lower case, no punctuation, noise words and postcodes dropped, abbreviations spelled out anywhere in the name."""
    return F.array_join(street_tokens(street), " ")


def normalise_number(number: Column) -> Column:
    return F.regexp_replace(F.lower(number), "[^a-z0-9]+", "")


def number_keys(number: Column) -> Column:
    """Keys a house number is found by, best first: itself, then what its range covers or its leading number."""
    full, text = normalise_number(number), F.lower(F.trim(number))
    low, high = (blank_to_null(F.regexp_extract(text, RANGE, k)).try_cast("bigint") for k in (1, 2))
    ranged = low.isNotNull() & high.isNotNull() & (low < high) & (high - low <= WIDEST_RANGE)
    # the bounds are kept ascending in every row: a descending sequence would run backwards
    first, last = F.least(low, high), F.greatest(low, high)
    step = F.when((last - first) % 2 == 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint")
    covered = F.transform(F.sequence(first, F.least(last, first + WIDEST_RANGE), step), lambda v: v.cast("string"))
    lead = blank_to_null(F.regexp_extract(text, r"^([0-9]+[a-z]?)", 1))
    return F.when(F.coalesce(ranged, F.lit(False)), F.array_distinct(F.concat(F.array(full), covered))).when(lead.isNotNull() & (lead != full), F.array(full, lead)).otherwise(F.array(full))


def parse_query(query: Column) -> Column:
    """Struct of unit, number (null if there is none) and street (what is left, up to a comma)."""
    text = F.trim(query)
    word = blank_to_null(F.regexp_extract(text, UNIT_WORD, 1))
    slash = blank_to_null(F.regexp_extract(text, UNIT_SLASH, 1))
    rest = F.when(word.isNotNull(), F.regexp_replace(text, UNIT_WORD, "")).when(slash.isNotNull(), F.regexp_replace(text, UNIT_SLASH, "")).otherwise(text)
    number = blank_to_null(F.regexp_extract(rest, NUMBER, 1))
    street = F.trim(F.substring_index(F.regexp_replace(rest, NUMBER, ""), ",", 1))
    return F.struct(F.coalesce(word, slash).alias("unit"), number.alias("number"), street.alias("street"))


def suffix_variants(street: Column) -> Column:
    """All prefixes of the normalised words, the longest first."""
    words = street_tokens(street)
    n = F.size(words)
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).otherwise(F.array().cast("array<string>"))


def parity(number: Column) -> Column:
    """even or odd by the leading digits; even without any."""
    return F.when(F.coalesce(leading_int(F.trim(number)), F.lit(0)) % 2 == 0, "even").otherwise("odd")


def natural_key(number: Column) -> Column:
    """Orders house numbers by their leading digits, then as text."""
    return F.struct(F.coalesce(leading_int(number), F.lit(0).cast("bigint")).alias("n"), number.alias("s"))


def speed_or_lanes(tag: Column) -> Column:
    return leading_int(F.trim(tag))


def address_label(unit: Column, number: Column, street: Column) -> Column:
    base = F.concat_ws(" ", number, street)
    return F.when(F.coalesce(unit, F.lit("")) != "", F.concat(unit, F.lit("/"), base)).otherwise(base)


def stop_label(number: Column, street: Column, doors: Column) -> Column:
    base = F.concat_ws(" ", number, street)
    return F.when(doors > 1, F.concat(base, F.lit(" ("), doors.cast("string"), F.lit(" doors)"))).otherwise(base)


def blockface_label(street: Column, side: Column, low: Column, high: Column, doors: Column, minutes: Column) -> Column:
    joiner = F.when(low.contains("-") | high.contains("-"), " to ").otherwise("-")
    span = F.when(low == high, F.concat(F.lit("#"), low)).otherwise(F.concat(F.lit("#"), low, joiner, F.lit("#"), high))
    where = F.when(side == "both", F.lit("")).otherwise(F.concat(F.lit(" ("), side, F.lit(")")))
    noun = F.when(doors == 1, " door").otherwise(" doors")
    return F.concat(street, where, F.lit(" "), span, F.lit(" - "), doors.cast("string"), noun, F.lit(" - "), F.bround(minutes, 0).cast("bigint").cast("string"), F.lit(" min"))


def zone_label(streets: Column, doors: Column) -> Column:
    more = F.size(streets) - 2
    head = F.concat(F.array_join(F.slice(streets, 1, 2), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    return F.concat(head, F.lit(" - "), doors.cast("string"), F.lit(" doors"))


def span_base(blockface_id: Column) -> Column:
    """What stands before the last #."""
    return F.regexp_replace(blockface_id, "#[^#]*$", "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
