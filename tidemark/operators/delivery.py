"""From topics to subscriptions: the index, and the fan-out of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import ack_id, parsed, valid


def subscription_index(journal: DataFrame) -> DataFrame:
    """(topic_id, subscription_id) of all subscriptions."""
    return journal.where(F.col("type") == "SubscriptionCreated").where(valid(F.col("topic_id")) & valid(F.col("subscription_id"))).select("topic_id", "subscription_id").distinct()


def subscriptions_of(index: DataFrame, topic_id: str) -> DataFrame:
    return index.where(F.col("topic_id") == topic_id).select("subscription_id")


def sets_per_topic(index: DataFrame) -> DataFrame:
    """(topic_id, subscription_ids): the set of each topic's subscriptions, in order. Subscriptions of one topic are few enough for a row."""
    return index.groupBy("topic_id").agg(F.sort_array(F.collect_set("subscription_id")).alias("subscription_ids"))


def per_topic(index: DataFrame) -> DataFrame:
    """(topic_id, subscriptions): how many there are."""
    return index.groupBy("topic_id").agg(F.count(F.lit(1)).alias("subscriptions"))


def fan_out(journal: DataFrame) -> DataFrame:
    """(subscription_id, ack_id, ordering, message): every message to the subscriptions that its topic had before it.

    The join is by topic, its sides as large as they are; skewed topics are split by adaptive execution.
    """
    topic = parsed("Topic", F.col("persistence_id"))
    messages = journal.where(F.col("type") == "MessagePublished").select(topic.alias("topic_id"), "ordering", "message").where(F.col("topic_id").isNotNull())
    subs = journal.where(F.col("type") == "SubscriptionCreated").groupBy("topic_id", "subscription_id").agg(F.min("ordering").alias("created"))
    met = messages.join(subs, "topic_id").where(F.col("ordering") > F.col("created"))
    return met.select("subscription_id", ack_id(F.col("subscription_id"), F.col("message.message_id")).alias("ack_id"), "ordering", "message")
