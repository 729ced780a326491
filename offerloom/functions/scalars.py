"""Dates, distances, salaries and ordered lists as native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filter_key, fold, stable_distinct

EARTH_KM = 6371.0088


def iso_timestamp(c: Column) -> Column:
    """Null if it cannot be read."""
    return F.try_to_timestamp(c)


def utc_instant(c: Column, zone: str = "UTC") -> Column:
    """A time with an offset is that instant, one without is local time in `zone`; null if it cannot be read."""
    at = F.try_to_timestamp(c)
    return F.when(c.rlike(r"(?i)(?:z|[+-]\d{2}:?\d{2})\s*$") & c.contains(":"), at).otherwise(F.to_utc_timestamp(at, zone))


def relative_date(c: Column, as_of: Column, word_bounded: bool = False) -> Column:
    """French and English relative dates, the first of minutes, hours, days, weeks and months (30 days) that is named."""
    text = fold(c)
    edge = r"\b" if word_bounded else ""
    out = [F.when(text.rlike(f"{edge}aujourd.?hui{edge}"), as_of), F.when(text.rlike(f"{edge}hier{edge}"), as_of - F.expr("interval 1 day"))]
    for words, seconds in (("minutes?|min", 60), ("heures?|hours?|h", 3600), ("jours?|days?|j", 86400), ("semaines?|weeks?", 604800), ("mois|months?", 2592000)):
        n = F.regexp_extract(text, rf"(\d+)\s*(?:{words})\b", 1)
        out.append(F.when(n != "", F.timestamp_seconds(F.unix_timestamp(as_of) - n.cast("long") * seconds)))
    return F.coalesce(*out)


def lenient_date(c: Column) -> Column:
    """ISO, else day/month/year, else day-month-year."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("dd/MM/yyyy")), F.try_to_timestamp(c, F.lit("dd-MM-yyyy")))


def cutoff(period: str, as_of: Column) -> Column | None:
    """The start of a period (24h, 3d, 7d); none for all."""
    hours = {"24h": 24, "3d": 72, "7d": 168, "all": None}[period]
    return None if hours is None else as_of - F.expr(f"interval {hours} hours")


def days_ago(c: Column, as_of: Column) -> Column:
    """Whole days, never below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(c)) / 86400)).cast("int")


#: Month names of long French dates.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def french_date(c: Column, zone: str = "Europe/Paris") -> Column:
    """A long French date in a time zone."""
    local = F.from_utc_timestamp(c, zone)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(local))
    return F.concat_ws(" ", F.dayofmonth(local).cast("string"), month, F.year(local).cast("string"))


def schedule_instant(as_of: Column, hour: int, minute: int, zone: str = "Europe/Paris") -> Column:
    """today's schedule in a time zone, as an instant; the earlier one where the clock shows it twice."""
    day = F.date_trunc("day", F.from_utc_timestamp(as_of, zone))
    return F.to_utc_timestamp(day + F.expr(f"interval {hour} hours {minute} minutes"), zone)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def nearest_radius(c: Column, allowed: tuple[int, ...] = (5, 10, 25, 50, 100)) -> Column:
    """M2: the smaller of two equally near."""
    return F.array_min(F.transform(F.array(*[F.lit(r) for r in allowed]), lambda r: F.struct(F.abs(r - c).alias("d"), r.alias("r"))))["r"]


def occurrences(c: Column, needle: str) -> Column:
    """M3: occurrences that do not overlap."""
    return F.regexp_count(c, F.lit(r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"))


def number(c: Column) -> Column:
    """A number with spaces and a decimal comma; null if it is none."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"[\s  ]", "").try_cast("double")


def text_salary(c: Column) -> Column:
    """The first two amounts and the currency of a free text."""
    amounts = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d   ]*(?:[.,]\d+)?)"), F.lit(1)), number)
    code = F.upper(F.regexp_extract(c, r"(?i)\b(EUR|USD|GBP|CHF)\b", 1))
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in (("€", "EUR"), ("$", "USD"), ("£", "GBP")) for x in kv]), F.regexp_extract(c, "([€$£])", 1))
    currency = F.coalesce(F.nullif(code, F.lit("")), sign)
    return F.struct(F.try_element_at(amounts, F.lit(1)).alias("low"), F.try_element_at(amounts, F.lit(2)).alias("high"), currency.alias("currency"))


def stated_minimum(c: Column) -> Column:
    """The amount before the first euro sign of a text."""
    return number(F.nullif(F.regexp_extract(c, r"(\d[\d\s\u00A0\u202F]*(?:[.,]\d+)?)\s*€", 1), F.lit("")))


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """P5: null without a bound or with no three-letter currency."""
    show = lambda x: F.format_number(x, 0)
    both = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(show(low), F.lit(" - "), show(high)))
    text = F.coalesce(both, F.when(low.isNotNull(), F.concat(F.when(high.isNull(), "from ").otherwise(""), show(low))), F.concat(F.lit("up to "), show(high)))
    return F.when(currency.rlike("^[A-Z]{3}$"), F.concat_ws(" ", text, F.when(text.isNotNull(), currency))).otherwise(None)


def has_salary(low: Column, high: Column, currency: Column) -> Column:
    """P6."""
    return currency.isNotNull() & (low.isNotNull() | high.isNotNull())


def split_list(c: Column) -> Column:
    """A1: parts between commas, semicolons and line ends, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, "[,;\n]"), lambda x: F.btrim(x)), lambda x: F.length(x) > 0)


def stable_union(a: Column, b: Column) -> Column:
    """A2: the first spelling of each key of both lists, in order."""
    empty = F.array().cast("array<string>")
    return stable_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def contains_all(items: Column, wanted: list[str]) -> Column:
    """A3: false for no wish."""
    if not wanted:
        return F.lit(False)
    keys = F.transform(items, filter_key)
    return F.size(F.array_except(F.transform(F.array(*[F.lit(w) for w in wanted]), filter_key), keys)) == 0


def contains_any(items: Column, wanted: list[str]) -> Column:
    """A4."""
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(F.transform(items, filter_key), F.transform(F.array(*[F.lit(w) for w in wanted]), filter_key))


def stable_intersection(a: Column, b: Column) -> Column:
    """A5: the distinct items of a that b has, in a's order."""
    return F.filter(F.array_distinct(a), lambda x: F.array_contains(b, x))


def contract_families(requested: Column, families: dict[str, str]) -> Column:
    """The distinct families of the requested contracts in the order in which they are first met; one null (no filter) if
    nothing is requested, none at all if nothing that is requested has a family."""
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    found = F.array_distinct(F.array_compact(F.transform(requested, lambda c: F.element_at(table, c))))
    return F.when(F.coalesce(F.size(requested), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(found)
