"""Timestamps in several encodings, decoded to seconds since year 0 (Gregorian)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1970-01-01 and 2100-01-01 in Gregorian seconds.
EPOCH = 62167219200
END = 66269664000


def _div(v: Column, n: int) -> Column:
    """Integer quotient of a non-negative number."""
    return ((v - F.pmod(v, F.lit(n))) / F.lit(n)).cast("long")


def decode_integer(v: Column) -> Column:
    """Gregorian seconds, Gregorian milliseconds or Unix seconds; else null."""
    return (
        F.when((v >= EPOCH) & (v <= END), v)
        .when((v >= 1000 * EPOCH) & (v <= 1000 * END), _div(v, 1000))
        .when((v >= 0) & (v < END - EPOCH), v + EPOCH)
        .cast("long")
    )


def _date_ok(y: Column, m: Column, d: Column) -> Column:
    return (y >= 1900) & (y < 2100) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)


def _midnight(y: Column, m: Column, d: Column) -> Column:
    # day of month counts on from the first, as 31 April is 1 May
    return (F.unix_date(F.make_date(y, m, F.lit(1))).cast("long") + d - 1) * 86400 + EPOCH


def decode_date(y: Column, m: Column, d: Column) -> Column:
    return F.when(_date_ok(y, m, d), _midnight(y, m, d))


def decode_datetime(y: Column, m: Column, d: Column, hour: Column, minute: Column, second: Column) -> Column:
    ok = _date_ok(y, m, d) & (hour >= 0) & (hour < 24) & (minute >= 0) & (minute < 60) & (second >= 0) & (second < 60)
    return F.when(ok, _midnight(y, m, d) + hour * 3600 + minute * 60 + second)


def decode_triple(a: Column, b: Column, c: Column) -> Column:
    """A triple is tried as a date first, then as (megaseconds, seconds, microseconds)."""
    now = (a >= 0) & (a <= (END - EPOCH) // 1_000_000) & (b >= 0) & (b < 1_000_000) & (c >= 0) & (c < 1_000_000)
    return F.coalesce(decode_date(a, b, c), F.when(now, a * 1_000_000 + b + EPOCH))


def decode_timestamp(v: Column) -> Column:
    """A Spark timestamp to Gregorian seconds."""
    return F.unix_seconds(v.cast("timestamp")) + EPOCH


def to_gmsecs(g: Column) -> Column:
    return g * 1000


def to_unix(g: Column) -> Column:
    return F.when(g.isNotNull(), F.greatest(g - EPOCH, F.lit(0).cast("long")))


def to_timestamp(g: Column) -> Column:
    return F.timestamp_seconds(g - EPOCH)


def to_date(g: Column) -> Column:
    return F.date_from_unix_date(F.floor((g - EPOCH) / 86400).cast("int"))


def to_now(g: Column) -> Column:
    u = g - EPOCH
    return F.struct(_div(u, 1_000_000).alias("megasecs"), F.pmod(u, F.lit(1_000_000)).alias("secs"), F.lit(0).alias("micros"))


def to_string(g: Column) -> Column:
    """YYYY-MM-DD[ HH:MM[:SS]]: zero parts at the end are left out."""
    u = g - EPOCH
    in_day = F.pmod(u, F.lit(86400))
    days = F.date_format(to_date(g), "yyyy-MM-dd")
    hour, minute, second = (F.lpad(((in_day - F.pmod(in_day, F.lit(n))) / n % m).cast("long").cast("string"), 2, "0") for n, m in ((3600, 24), (60, 60), (1, 60)))
    return F.when(in_day == 0, days).when(F.pmod(in_day, F.lit(60)) == 0, F.concat(days, F.lit(" "), hour, F.lit(":"), minute)).otherwise(F.concat(days, F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second))
