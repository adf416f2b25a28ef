"""Read models: each is a function of the journal, so a rebuild and an increment give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import parsed
from ..functions.messages import age_seconds, expired, instant
from ..schemas import TERMINAL
from .subscriptions import by_ack


def leases(journal: DataFrame) -> DataFrame:
    """(subscription_id, ack_id, deadline) of the ids whose last lease event sets a deadline."""
    e = by_ack(journal.where(F.col("type") != "MessageDelivered")).select("subscription_id", "ack_id", "ordering", "type", "deadline")
    sets = F.when(F.col("type").isin("MessageLeased", "AckDeadlineModified"), F.col("ordering"))
    last = e.groupBy("subscription_id", "ack_id").agg(F.max("ordering").alias("last"), F.max(sets).alias("set"), F.max_by("deadline", sets).alias("deadline"))
    return last.where(F.col("set") == F.col("last")).select("subscription_id", "ack_id", "deadline")


def overdue(leases: DataFrame, now) -> DataFrame:
    return leases.where(F.col("deadline") <= instant(now))


def expiring(journal: DataFrame) -> DataFrame:
    """(subscription_id, ack_id, expire_time) of delivered messages with an expiry that haven't been removed."""
    e = by_ack(journal.where(F.col("type").isin(TERMINAL) | (F.col("type") == "MessageDelivered") & F.col("message.expire_time").isNotNull())).select("subscription_id", "ack_id", "ordering", "type", F.col("message.expire_time").alias("expire_time"))
    came = F.when(F.col("type") == "MessageDelivered", F.col("ordering"))
    last = e.groupBy("subscription_id", "ack_id").agg(F.max("ordering").alias("last"), F.max(came).alias("came"), F.max_by("expire_time", came).alias("expire_time"))
    return last.where(F.col("came") == F.col("last")).select("subscription_id", "ack_id", "expire_time")


def past(expiring: DataFrame, now) -> DataFrame:
    return expiring.where(expired(F.col("expire_time"), now))


def backlog(journal: DataFrame) -> DataFrame:
    """(subscription_id, ack_id, delivered_at): the publish time of the first delivery since the last removal."""
    out = by_ack(journal.where(F.col("type").isin(TERMINAL))).groupBy("subscription_id", "ack_id").agg(F.max("ordering").alias("out"))
    came = by_ack(journal.where(F.col("type") == "MessageDelivered")).select("subscription_id", "ack_id", "ordering", F.col("message.publish_time").alias("at"))
    since = came.join(out, ["subscription_id", "ack_id"], "left").where(F.col("out").isNull() | (F.col("ordering") > F.col("out")))
    return since.groupBy("subscription_id", "ack_id").agg(F.min_by("at", "ordering").alias("delivered_at"))


def subscription_counters(journal: DataFrame) -> DataFrame:
    """(subscription_id, topic_id, redelivered_total, dead_lettered_total). Deliveries given back count as redelivered."""
    sub = parsed("Subscription", F.col("persistence_id"))
    made = journal.where(F.col("type") == "SubscriptionCreated").where(sub.isNotNull()).groupBy(F.coalesce("subscription_id", sub).alias("subscription_id")).agg(F.max_by("topic_id", "ordering").alias("topic_id"))
    j = journal.where(F.col("type").isin("AckDeadlineExpired", "MessageDeadLettered")).select(sub.alias("subscription_id"), "type").where(F.col("subscription_id").isNotNull())
    counts = j.groupBy("subscription_id").agg(F.count_if(F.col("type") == "AckDeadlineExpired").alias("redelivered_total"), F.count_if(F.col("type") == "MessageDeadLettered").alias("dead_lettered_total"))
    g = made.where(F.length(F.coalesce("topic_id", F.lit(""))) > 0).join(counts, "subscription_id", "left")
    return g.select("subscription_id", "topic_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("redelivered_total", "dead_lettered_total")])


def subscription_stats(counters: DataFrame, backlog: DataFrame) -> DataFrame:
    """Counters with backlog and oldest delivery. The backlog is counted before it is joined, so the join is one to one."""
    b = backlog.groupBy("subscription_id").agg(F.count("ack_id").alias("backlog"), F.min("delivered_at").alias("oldest"))
    return counters.join(b, "subscription_id", "left").withColumn("backlog", F.coalesce("backlog", F.lit(0)))


def subscription_listing(stats: DataFrame, now) -> DataFrame:
    return stats.select("subscription_id", "topic_id", "backlog", age_seconds(F.col("oldest"), now).alias("oldest_age_seconds"), "redelivered_total", "dead_lettered_total")


def topic_stats(journal: DataFrame) -> DataFrame:
    """(topic_id, published_total, deleted)."""
    topic = parsed("Topic", F.col("persistence_id"))
    j = journal.where(F.col("type").isin("TopicCreated", "MessagePublished", "TopicDeleted")).select(topic.alias("topic_id"), "type").where(F.col("topic_id").isNotNull())
    return j.groupBy("topic_id").agg(F.count_if(F.col("type") == "MessagePublished").alias("published_total"), F.bool_or(F.col("type") == "TopicDeleted").alias("deleted"))


def topic_listing(stats: DataFrame) -> DataFrame:
    return stats.select("topic_id", "published_total", "deleted")


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], removed: str) -> DataFrame:
    """A table after a batch of changes (same columns, and a flag ``removed``): one change of a key replaces its row.

    Parquet tables have no MERGE, so a new version is made; its rows without changes are an anti-join.
    """
    kept = old.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.where(~F.col(removed)).select(*old.columns))
