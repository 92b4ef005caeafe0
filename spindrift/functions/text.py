"""Scalar functions on text, money and dates, as Column expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_cents(text: Column) -> Column:
    """'$39,600.51' -> 3960051; without a digit, or with more than one point, null."""
    digits = F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit(""))
    return F.bround(digits.try_cast("double") * 100).cast("long")


def clean_text(text: Column) -> Column:
    """White space collapsed; blank, 'none' and 'n/a' in any case are null."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.lower(t).isin("", "none", "n/a"), None).otherwise(t)


# The accepted date formats, tried in this order.
DATE_FORMATS = ("MMMM d, yyyy", "yyyy-M-d", "MMMM yyyy", "yyyy")


def iso_date(text: Column) -> Column:
    t = clean_text(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMATS])


def with_sign(size: Column, of: Column) -> Column:
    """``size`` with the sign of ``of``, also where it is zero: Spark's rounding drops the sign of what comes to nothing."""
    return size * F.signum(of)


def percent_of(level: Column, digits: int = 1) -> Column:
    """A log level as a percentage change; a fall too small to show is -0.0."""
    change = (F.exp(level) - 1) * 100
    return with_sign(F.bround(F.abs(change), digits), change)


def usd(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(cents / 100, 2))


def signed_percent(share: Column) -> Column:
    """'+12%', '−3%' with a minus sign proper, '0%' without one."""
    p = F.bround(share * 100, 0).cast("long")
    sign = F.when(p > 0, "+").when(p < 0, "−").otherwise("")
    return F.concat(sign, F.abs(p).cast("string"), F.lit("%"))


def binned(value: Column, edges: list[float], labels: list[str], right: bool) -> Column:
    """The label of the bin of ``value``; outside all bins or null, 'unknown'. The last edge is
    infinity. ``right``: bins hold their upper edge instead of their lower one."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (value > low) & (value <= high) if right else (value >= low) & (value < high)
        if high == float("inf"):
            inside = value > low if right else value >= low
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise("unknown")


def ascii_lower(text: Column) -> Column:
    """A-Z alone are folded."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def name_contains(name: Column, query: str) -> Column:
    """Substring whatever the case of A-Z; %, _ and \\ in the query stand for themselves."""
    return F.contains(ascii_lower(name), F.lit(query.translate(str.maketrans(ascii_uppercase, ascii_lowercase))))


def split_matched(text: Column) -> Column:
    """'a & b | c' -> ['a & b', 'c']."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r" \| "), lambda x: F.trim(x)), lambda x: x != "")


MAX_IDS = 6


def split_ids(text: Column) -> Column:
    """'3,1,3' -> [3, 1]: in order, each once, MAX_IDS at most; what is no number is left out."""
    ids = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long"))
    return F.slice(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())), 1, MAX_IDS)


def parse_ids(text: str) -> list[int]:
    """The same on the driver; what is no number raises ValueError."""
    return list(dict.fromkeys(int(x) for x in text.split(",") if x.strip()))[:MAX_IDS]


def condition_order(condition: Column) -> Column:
    return F.when(condition == "loose", 0).when(condition == "cib", 1).otherwise(2)


def unit_normal_two_sided(z: float) -> float:
    """P(|Z| >= z)."""
    import math

    return math.erfc(abs(z) / math.sqrt(2))


def deadline_from(until: Column, now: Column) -> Column:
    """The next time of day 'HH:MM' after a timestamp: of the same day, or of the next one if that
    has passed; null for what is no time of day."""
    pattern = r"^\s*([01]?\d|2[0-3]):([0-5]\d)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(until, pattern, k), F.lit("")).cast("int")
    day = lambda ahead: F.date_trunc("day", now) + F.make_dt_interval(days=F.lit(ahead), hours=part(1), mins=part(2))
    return F.when(day(0) > now, day(0)).otherwise(day(1))
