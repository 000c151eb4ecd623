"""Column expressions shared by the operators; all of them stay in codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

RETRY_BASE_SECONDS = 10
RETRY_MAX_EXPONENT = 6


def instant(value: str | dt.datetime | Column) -> Column:
    """A reference time as a timestamp literal in the session time zone."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def day(value: str | dt.date | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Fractional seconds from start to end."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, half a second rounding away from zero."""
    return half_up(F.unix_micros(end) - F.unix_micros(start), F.lit(1000000)).cast("int")


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def half_up(numerator: Column, denominator: Column, digits: int = 0) -> Column:
    """numerator / denominator rounded half away from zero, from integers only.

    Doing it on integers keeps the result the same whatever the decimal or
    floating type a division would have picked.  NULL when the denominator is 0.
    """
    scale = 10**digits
    den = F.nullif(denominator.cast("long"), F.lit(0).cast("long"))
    num = numerator.cast("long")
    size = _floor_div(2 * scale * F.abs(num) + den, 2 * den)
    return (F.signum(num) * size / F.lit(float(scale))).cast("double")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_up(part * 100, whole, digits)


def retry_at(base: Column, attempts: Column) -> Column:
    """base + 10 s * 2^min(attempts, 6)."""
    exponent = F.least(attempts, F.lit(RETRY_MAX_EXPONENT))
    seconds = F.lit(RETRY_BASE_SECONDS) * F.pow(F.lit(2), exponent)
    return base + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter or digit.

    Spark's initcap starts words at white space only.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), ""
    )


def confidence_tier(confidence: Column) -> Column:
    """Review tier: up to 50 deep, up to 80 light, else auto."""
    return F.when(confidence <= 50, "deep").when(confidence <= 80, "light").otherwise("auto")
