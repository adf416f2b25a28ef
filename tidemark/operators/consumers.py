"""Who pulls: consumers seen within the activity window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.messages import instant, plus_ms


def last_seen(calls: DataFrame) -> DataFrame:
    """(subscription_id, consumer_id, last_seen) of calls (subscription_id, consumer_id, at); calls without a consumer don't count."""
    named = calls.where(F.length(F.coalesce(F.col("consumer_id"), F.lit(""))) > 0)
    return named.groupBy("subscription_id", "consumer_id").agg(F.max("at").alias("last_seen"))


def active(calls: DataFrame, now, window_ms: int = 60_000) -> DataFrame:
    """(subscription_id, active_consumers), for those that have any. A window of 0 turns the count off."""
    seen = last_seen(calls).where(F.lit(window_ms > 0) & (F.col("last_seen") >= plus_ms(instant(now), -window_ms)))
    return seen.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("active_consumers"))
