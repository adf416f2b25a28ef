"""Events as JSON: one object with a ``type``, without the fields that an event doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import SUBSCRIPTION_EVENTS, TOPIC_EVENTS
from .messages import iso

WIRE_MESSAGE = "struct<id:string,payload:string,attributes:map<string,string>,publishTime:string,expireTime:string,idempotencyKey:string>"
WIRE = f"type string, topicId string, subscriptionId string, labels map<string,string>, message {WIRE_MESSAGE}, ackId string, ackIds array<string>, deadline string, attempt int"


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """A journal with its events' JSON in one more column. Nulls are left out."""
    m = F.col("message")
    message = F.when(m.isNotNull(), F.struct(m["message_id"].alias("id"), F.base64(m["payload"]).alias("payload"), m["attributes"].alias("attributes"), iso(m["publish_time"]).alias("publishTime"), iso(m["expire_time"]).alias("expireTime"), m["idempotency_key"].alias("idempotencyKey")))
    fields = F.struct("type", F.col("topic_id").alias("topicId"), F.col("subscription_id").alias("subscriptionId"), "labels", message.alias("message"), F.col("ack_id").alias("ackId"), F.col("ack_ids").alias("ackIds"), iso(F.col("deadline")).alias("deadline"), "attempt")
    return df.withColumn(name, F.to_json(fields))


def _instant(x: Column) -> Column:
    return F.to_timestamp_ntz(F.regexp_replace(x, "Z$", ""))


def from_json(df: DataFrame, name: str = "json") -> DataFrame:
    """The fields of events in JSON. Absent fields are null (labels of a new topic: none); an unknown type fails."""
    e = df.withColumn("_e", F.from_json(name, WIRE))
    m = F.col("_e.message")
    known = F.when(F.col("_e.type").isin([*TOPIC_EVENTS, *SUBSCRIPTION_EVENTS]), F.col("_e.type")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(F.col(name), F.lit("null")))).cast("string"))
    message = F.when(m.isNotNull(), F.struct(m["id"].alias("message_id"), F.unbase64(m["payload"]).alias("payload"), F.coalesce(m["attributes"], F.create_map().cast("map<string,string>")).alias("attributes"), _instant(m["publishTime"]).alias("publish_time"), _instant(m["expireTime"]).alias("expire_time"), F.nullif(m["idempotencyKey"], F.lit("")).alias("idempotency_key")))
    no_labels = F.when(F.col("_e.type").isin("TopicCreated", "TopicLabelsUpdated"), F.create_map().cast("map<string,string>"))
    return e.select(*df.columns, known.alias("type"), F.col("_e.topicId").alias("topic_id"), F.col("_e.subscriptionId").alias("subscription_id"), F.coalesce("_e.labels", no_labels).alias("labels"), message.alias("message"), F.col("_e.ackId").alias("ack_id"), F.col("_e.ackIds").alias("ack_ids"), _instant(F.col("_e.deadline")).alias("deadline"), F.col("_e.attempt").alias("attempt"))
