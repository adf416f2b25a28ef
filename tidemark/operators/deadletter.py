"""Dead letters: what becomes of messages that were delivered too often."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import dead_letter_id, parsed


#: The headers of a dead letter.
SUBSCRIPTION_HEADER, ATTEMPTS_HEADER, ORIGINAL_HEADER = "x-dead-letter-subscription", "x-delivery-attempts", "x-original-message-id"


def dead_letters(journal: DataFrame, topic: str | None) -> DataFrame:
    """Publish commands (topic_id, message, source_subscription, attempt) to the dead-letter topic; none without one.

    A message gets a new id and headers over its own attributes, and loses its expiry and idempotency key. A message
    that a replayed event would republish is republished once.
    """
    sub = parsed("Subscription", F.col("persistence_id"))
    j = journal.where((F.col("type") == "MessageDeadLettered") & F.lit(topic is not None)).select(sub.alias("sub"), "message", "attempt", "ordering").where(F.col("sub").isNotNull())
    m = F.col("message")
    once = j.groupBy("sub", m["message_id"].alias("id")).agg(F.max_by(F.struct("message", "attempt"), "ordering").alias("x")).select("sub", "x.*")
    headers = F.create_map(F.lit(SUBSCRIPTION_HEADER), F.col("sub"), F.lit(ATTEMPTS_HEADER), F.col("attempt").cast("string"), F.lit(ORIGINAL_HEADER), m["message_id"])
    own = F.map_filter(F.coalesce(m["attributes"], F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(SUBSCRIPTION_HEADER, ATTEMPTS_HEADER, ORIGINAL_HEADER))
    new = F.struct(dead_letter_id(F.col("sub"), m["message_id"]).alias("message_id"), m["payload"].alias("payload"), F.map_concat(own, headers).alias("attributes"), m["publish_time"].alias("publish_time"), F.lit(None).cast("timestamp_ntz").alias("expire_time"), F.lit(None).cast("string").alias("idempotency_key"))
    return once.select(F.lit(topic).alias("topic_id"), new.alias("message"), F.col("sub").alias("source_subscription"), "attempt")


def routed(letters: DataFrame, topics: DataFrame) -> DataFrame:
    """Letters with the dead-letter topic's real outcome: Published, or the rejection of a topic that isn't there."""
    there = topics.select("topic_id").distinct().withColumn("_there", F.lit(True))
    return letters.join(there, "topic_id", "left").withColumn("outcome", F.when(F.col("_there"), "Published").otherwise("TopicNotFound")).drop("_there")


def unsent(letters: DataFrame, published: DataFrame) -> DataFrame:
    """The letters that aren't among the published messages (message_id) of their topic yet, so a replay republishes nothing."""
    sent = published.select(F.col("message_id").alias("_sent"))
    return letters.join(sent, F.col("message.message_id") == F.col("_sent"), "left_anti")
