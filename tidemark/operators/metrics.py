"""The metrics page as a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.exposition import CONSUMER_METRICS, SUBSCRIPTION_METRICS, TOPIC_METRICS, lines


def page(subscription_listing: DataFrame, topic_listing: DataFrame, active_consumers: DataFrame) -> DataFrame:
    """(block, position, line), in whose order the lines make the page."""
    subs = lines(subscription_listing, SUBSCRIPTION_METRICS, "subscription", "subscription_id")
    topics = lines(topic_listing, TOPIC_METRICS, "topic", "topic_id")
    consumers = lines(active_consumers, CONSUMER_METRICS, "subscription", "subscription_id")
    return subs.unionByName(topics).unionByName(consumers)
