"""Rounding, ratios, dates and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    """Half up to one decimal, for x >= 0."""
    return F.floor(x * 10 + 0.5) / 10


def round_away(x: Column, places: int) -> Column:
    """Half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 10**places + 0.5) / 10**places


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """part of whole as a percentage, half up to one decimal, 0 where whole is 0. A thousand times the ratio in one step: times 100 and then times 10
    rounds twice and may end just under a half, as with 23 of 80."""
    return F.floor(ratio(part, whole) * 1000 + 0.5) / 10


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def damped(accuracy: Column, n: Column, full: int = 5) -> Column:
    """A percentage that few attempts pull towards 0."""
    return F.when(n < full, accuracy * n / full).otherwise(accuracy)


def millis_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)


def add_days(ts: Column, days: Column) -> Column:
    """ts plus a fractional number of days, to the microsecond."""
    return F.timestamp_micros((F.unix_micros(ts) + F.round(days * 86_400_000_000)).cast("long"))


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000


def lenient_timestamp(x: Column) -> Column:
    """Two layouts; whatever is neither is null."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def eta_seconds(median_ms: Column, remaining: Column, concurrency: Column) -> Column:
    """Whole seconds left, by integer division."""
    return F.floor(F.floor(median_ms * remaining / F.greatest(concurrency, F.lit(1))) / 1000)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either is all zero, null if their sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))
