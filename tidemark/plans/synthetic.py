"""A journal made from the ``events`` table: every event type is a topic with three subscriptions.

Row ``event_id`` is published as ``m-<event_id>``. Subscription i of a topic starts i times ten days after the first
event. What happens to a delivery depends on (event_id + i) mod 10, see ``LIFECYCLE``. The ordering of an event is
100 times its event_id, plus 20 for each subscription, plus its step, so it is a total order without a shuffle.

The journal is made once for each folder and application and stored by event type, as a broker's journal is; a reader of
some types reads those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import JOURNAL
from ..sources import journal as store
from ..storage import shared_folder

NOW = "2024-01-15 00:00:00"
SUBSCRIPTIONS, DAYS_APART, CASES = 3, 10, 10

#: The stored journal of each application and folder.
_STORED: dict[tuple[str, str], str] = {}

#: Fixed values: (case, step, event type, attempt).
LIFECYCLE = [
    (1, 1, "MessageLeased", None), (1, 2, "MessageAcknowledged", None),
    (2, 1, "MessageLeased", None), (2, 2, "AckDeadlineExpired", 1), (2, 3, "MessageLeased", None), (2, 4, "MessageAcknowledged", None),
    (3, 1, "MessageLeased", None), (3, 2, "AckDeadlineExpired", 1), (3, 3, "MessageLeased", None), (3, 4, "AckDeadlineExpired", 2), (3, 5, "MessageLeased", None),
    (3, 6, "AckDeadlineExpired", 3), (3, 7, "MessageLeased", None), (3, 8, "AckDeadlineExpired", 4), (3, 9, "MessageLeased", None), (3, 10, "MessageDeadLettered", 5),
    (4, 1, "MessageLeased", None), (4, 2, "AckDeadlineModified", None),
    (5, 1, "MessageLeased", None), (5, 2, "AckDeadlineExpired", 0),
    (6, 1, "MessageExpired", None),
    (7, 1, "MessageLeased", None), (7, 2, "AckDeadlineExpired", 1),
    (8, 1, "MessageLeased", None), (8, 2, "AckDeadlineExpired", 1), (8, 3, "MessageLeased", None), (8, 4, "AckDeadlineExpired", 2), (8, 5, "MessageLeased", None),
    (9, 1, "MessageLeased", None), (9, 2, "AckDeadlineExpired", 1), (9, 3, "MessageLeased", None), (9, 4, "AckDeadlineExpired", 2), (9, 5, "MessageLeased", None),
    (9, 6, "AckDeadlineExpired", 3), (9, 7, "MessageLeased", None), (9, 8, "AckDeadlineExpired", 4), (9, 9, "MessageLeased", None),
]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def messages(e: DataFrame) -> DataFrame:
    """(event_id, topic_id, message) of every published event."""
    expire = F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.make_dt_interval(secs=(60 + F.col("event_id") % 600).cast("decimal(18,6)")))
    message = F.struct(F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("message_id"), F.col("props").cast("binary").alias("payload"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attributes"), F.col("ts").alias("publish_time"), expire.alias("expire_time"), F.get_json_object("props", "$.k").alias("idempotency_key"))
    return e.select("event_id", F.col("event_type").alias("topic_id"), message.alias("message"))


def subscriptions(e: DataFrame) -> DataFrame:
    """(topic_id, i, subscription_id, created_at, ordering); as many rows as there are topics times three."""
    topics = e.select(F.col("event_type").alias("topic_id")).distinct()
    first = e.agg(F.min("ts").alias("t0"))
    each = topics.crossJoin(F.broadcast(first)).select("topic_id", "t0", F.explode(F.sequence(F.lit(0), F.lit(SUBSCRIPTIONS - 1))).alias("i")).withColumn("created_at", F.col("t0") + F.make_dt_interval(days=F.col("i") * DAYS_APART))
    starts = each.select("created_at").distinct()
    at = e.join(F.broadcast(starts), F.col("ts") >= F.col("created_at")).groupBy("created_at").agg(F.min("event_id").alias("after"))
    ranked = each.join(F.broadcast(at), "created_at")
    return ranked.select("topic_id", "i", F.format_string("s-%s-%d", "topic_id", "i").alias("subscription_id"), "created_at", (100 * F.col("after") - 1).alias("ordering"))


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """All events of topics and subscriptions, in the journal's schema, from a stored journal."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = shared_folder(spark)
        store.append(generated(spark, folder), path)
        _STORED[key] = path
    return store.read(spark, _STORED[key])


def generated(spark: SparkSession, folder: str) -> DataFrame:
    """The same events, made from the ``events`` table anew."""
    e = events(spark, folder)
    m, subs = messages(e), subscriptions(e)
    empty = {"labels": "map<string,string>", "message": m.schema["message"].dataType, "ack_id": "string", "ack_ids": "array<string>", "deadline": "timestamp_ntz", "attempt": "int", "topic_id": "string", "subscription_id": "string"}
    columns = [x.strip().split(" ")[0] for x in ("ordering", "persistence_id", "type", "topic_id", "subscription_id", "labels", "message", "ack_id", "ack_ids", "deadline", "attempt")]

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(empty[c]).alias(c) for c in columns])

    topic = lambda c: F.concat(F.lit("Topic|"), c)
    topics = e.select(F.col("event_type").alias("topic_id")).distinct()
    created = topics.select(F.lit(-100).cast("long").alias("ordering"), topic(F.col("topic_id")).alias("persistence_id"), F.lit("TopicCreated").alias("type"), "topic_id", F.create_map(F.lit("kind"), "topic_id").alias("labels"))
    published = m.select((100 * F.col("event_id")).alias("ordering"), topic(F.col("topic_id")).alias("persistence_id"), F.lit("MessagePublished").alias("type"), "message")
    sub = F.concat(F.lit("Subscription|"), "subscription_id")
    started = subs.select("ordering", sub.alias("persistence_id"), F.lit("SubscriptionCreated").alias("type"), "topic_id", "subscription_id")

    fan = m.join(F.broadcast(subs.withColumnRenamed("ordering", "created")), "topic_id").where(100 * F.col("event_id") > F.col("created"))
    base = fan.select((100 * F.col("event_id") + 20 * F.col("i") + 1).alias("base"), sub.alias("persistence_id"), F.concat_ws(":", "subscription_id", F.col("message.message_id")).alias("ack_id"), "message", "event_id", ((F.col("event_id") + F.col("i")) % CASES).alias("case"))
    delivered = base.select(F.col("base").alias("ordering"), "persistence_id", F.lit("MessageDelivered").alias("type"), "ack_id", "message")
    steps = spark.createDataFrame(LIFECYCLE, "case long, step long, type string, attempt int")
    later = base.join(F.broadcast(steps), "case").where(((F.col("case") != 6) | F.col("message.expire_time").isNotNull()) & ((F.col("type") != "AckDeadlineModified") | (F.col("event_id") % 3 == 0)))
    leased = F.col("type") == "MessageLeased"
    deadline = F.when(leased, F.col("message.publish_time") + F.make_dt_interval(secs=(30 * F.col("step")).cast("decimal(18,6)"))).when(F.col("type") == "AckDeadlineModified", F.col("message.publish_time") + F.make_dt_interval(days=F.lit(10)))
    later = later.select((F.col("base") + F.col("step")).alias("ordering"), "persistence_id", "type", F.when(~leased, F.col("ack_id")).alias("ack_id"), F.when(leased, F.array("ack_id")).alias("ack_ids"), F.when(F.col("type") == "MessageDeadLettered", F.col("message")).alias("message"), deadline.alias("deadline"), "attempt")
    parts = [shaped(x) for x in (created, published, started, delivered, later)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["JOURNAL", "LIFECYCLE", "NOW", "events", "generated", "journal", "messages", "subscriptions"]
