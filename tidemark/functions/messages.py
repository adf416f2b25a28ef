"""Expressions on messages and times. Bounds are inclusive, as in the broker's rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def instant(now) -> Column:
    """A clock reading as a column: an ISO string, or a column as it is."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def plus_ms(t: Column, ms) -> Column:
    """t and so many whole milliseconds."""
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return t + F.make_dt_interval(secs=ms.cast("decimal(18,3)") / F.lit(1000).cast("decimal(18,3)"))


def expired(expire_time: Column, now) -> Column:
    return expire_time.isNotNull() & (expire_time <= instant(now))


def expire_at(publish_time: Column, ttl_ms: Column, default_ms: int = 0) -> Column:
    """A positive TTL, or else the default one; whole seconds only; null without any."""
    ttl = F.when(ttl_ms > 0, ttl_ms).otherwise(F.lit(default_ms)).cast("long")
    return F.when(ttl > 0, publish_time + F.make_dt_interval(secs=F.floor(ttl / 1000).cast("decimal(18,6)")))


def micros(t: Column) -> Column:
    """A timestamp's microseconds since 1970 in UTC."""
    whole = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", whole, t)


def within(earlier: Column, later: Column, window_ms: int) -> Column:
    """Whether ``earlier`` lies in the window that ends at ``later``."""
    return micros(earlier) >= micros(later) - window_ms * 1000


def age_seconds(oldest: Column, now) -> Column:
    """Whole seconds since then, 0 for none and for the future."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.timestamp_diff("SECOND", oldest, instant(now)), F.lit(0).cast("long")))


def iso(t: Column) -> Column:
    """An ISO instant; a whole second has no fraction."""
    return F.concat(F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$", ""), F.lit("Z"))


def text(payload: Column) -> Column:
    return payload.cast("string")
