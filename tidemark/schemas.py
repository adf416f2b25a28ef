"""The journal's and read models' schemas. Times are timestamps without zone in UTC."""

from __future__ import annotations

import time

MESSAGE = "struct<message_id:string,payload:binary,attributes:map<string,string>,publish_time:timestamp_ntz,expire_time:timestamp_ntz,idempotency_key:string>"

JOURNAL = f"ordering long, persistence_id string, type string, topic_id string, subscription_id string, labels map<string,string>, message {MESSAGE}, ack_id string, ack_ids array<string>, deadline timestamp_ntz, attempt int"

TOPIC_COMMANDS = f"ordering long, topic_id string, kind string, labels map<string,string>, message {MESSAGE}"

SUBSCRIPTION_COMMANDS = f"ordering long, subscription_id string, kind string, topic_id string, ack_id string, message {MESSAGE}, max int, deadline_ms long, now timestamp_ntz, max_attempts int"

#: Read models by name; ``create_tables`` makes them as Parquet tables of the session's catalog.
READ_MODELS = {
    "topic_subscriptions": "topic_id string, subscription_id string",
    "outstanding_leases": "subscription_id string, ack_id string, deadline timestamp_ntz",
    "subscription_backlog": "subscription_id string, ack_id string, delivered_at timestamp_ntz",
    "subscription_stats": "subscription_id string, topic_id string, redelivered_total long, dead_lettered_total long",
    "topic_stats": "topic_id string, published_total long, deleted boolean",
    "expiring_messages": "subscription_id string, ack_id string, expire_time timestamp_ntz",
}

#: The event types of topics and of subscriptions, and the tags under which each is read.
TOPIC_EVENTS = ["TopicCreated", "MessagePublished", "TopicDeleted", "TopicLabelsUpdated"]
SUBSCRIPTION_EVENTS = ["SubscriptionCreated", "MessageDelivered", "MessageLeased", "MessageAcknowledged", "AckDeadlineModified", "AckDeadlineExpired", "MessageDeadLettered", "MessageExpired"]
TAGS = {
    "topic-stats": ["TopicCreated", "MessagePublished", "TopicDeleted"],
    "topic-message": ["MessagePublished"],
    "subscription-created": ["SubscriptionCreated"],
    "subscription-stats": SUBSCRIPTION_EVENTS,
    "subscription-lease": SUBSCRIPTION_EVENTS[2:],
}
TERMINAL = ["MessageAcknowledged", "MessageDeadLettered", "MessageExpired"]


def create_tables(spark, database: str = "default", max_wait_ms: int = 0, step_ms: int = 1_000) -> None:
    """The read models' tables, where they don't exist yet; a catalog that isn't there is tried again until the wait is over."""
    end = time.monotonic() + max_wait_ms / 1000
    while True:
        try:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
            for name, ddl in READ_MODELS.items():
                spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")
            return
        except Exception:
            if time.monotonic() + step_ms / 1000 > end:
                raise
            time.sleep(step_ms / 1000)
