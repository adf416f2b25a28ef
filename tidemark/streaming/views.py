"""Read models kept up to date from a journal's stream.

A view is a folder with a version for each batch (``v=<batch>``) and is read at its latest version. A batch makes its
version from the one before it and from its own events alone, and writes it as a whole. A batch that is run again
overwrites its own version with the same rows, so counters count each event once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import parsed
from ..operators.subscriptions import by_ack
from ..schemas import TERMINAL


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The batches with a whole version (one version is kept for each of the last batches only)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A view's latest version (before a batch); empty if there is none."""
    v = [n for n in _versions(spark, path) if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{path}/v={v[-1]}") if v else spark.createDataFrame([], schema)


def maintained(stream: DataFrame, path: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Runs ``step(view, batch)`` for each batch until the stream's files are used up."""

    def batch(events: DataFrame, number: int) -> None:
        spark = events.sparkSession
        view = current(spark, path, schema, before=number)
        step(view, events).write.mode("overwrite").parquet(f"{path}/v={number}")
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        for n in _versions(spark, path)[:-keep]:
            old = fs_path(f"{path}/v={n}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOPIC_STATS = "topic_id string, published_total long, deleted boolean"


def topic_stats_step(view: DataFrame, events: DataFrame) -> DataFrame:
    from ..operators.readmodels import topic_stats

    both = view.unionByName(topic_stats(events))
    return both.groupBy("topic_id").agg(F.sum("published_total").alias("published_total"), F.bool_or("deleted").alias("deleted"))


COUNTERS = "subscription_id string, topic_id string, redelivered_total long, dead_lettered_total long"


def counters_step(view: DataFrame, events: DataFrame) -> DataFrame:
    sub = parsed("Subscription", F.col("persistence_id"))
    new = events.where(F.col("type").isin("SubscriptionCreated", "AckDeadlineExpired", "MessageDeadLettered")).select(sub.alias("subscription_id"), F.when(F.col("type") == "SubscriptionCreated", F.col("topic_id")).alias("topic_id"), (F.col("type") == "AckDeadlineExpired").cast("long").alias("redelivered_total"), (F.col("type") == "MessageDeadLettered").cast("long").alias("dead_lettered_total"))
    both = view.unionByName(new.where(F.col("subscription_id").isNotNull()))
    return both.groupBy("subscription_id").agg(F.max("topic_id").alias("topic_id"), F.sum("redelivered_total").alias("redelivered_total"), F.sum("dead_lettered_total").alias("dead_lettered_total"))


LEASES = "subscription_id string, ack_id string, deadline timestamp_ntz"


def leases_step(view: DataFrame, events: DataFrame) -> DataFrame:
    """The last lease event of a batch replaces what the view has of its ack id."""
    from ..operators.readmodels import upsert

    e = by_ack(events.where(F.col("type") != "MessageDelivered"))
    sets = F.when(F.col("type").isin("MessageLeased", "AckDeadlineModified"), F.col("ordering"))
    last = e.groupBy("subscription_id", "ack_id").agg(F.max("ordering").alias("last"), F.max(sets).alias("set"), F.max_by("deadline", sets).alias("deadline"))
    changes = last.select("subscription_id", "ack_id", "deadline", (F.col("set").isNull() | (F.col("set") < F.col("last"))).alias("removed"))
    return upsert(view, changes, ["subscription_id", "ack_id"], "removed")


EXPIRING = "subscription_id string, ack_id string, expire_time timestamp_ntz"


def expiring_step(view: DataFrame, events: DataFrame) -> DataFrame:
    """Deliveries with an expiry come in, removals take out; the last of a batch counts."""
    from ..operators.readmodels import expiring, upsert

    keys = ["subscription_id", "ack_id"]
    mine = events.where(F.col("type").isin(TERMINAL) | (F.col("type") == "MessageDelivered") & F.col("message.expire_time").isNotNull())
    touched = by_ack(mine).select(*keys).distinct()
    changes = touched.join(expiring(mine), keys, "left").withColumn("removed", F.col("expire_time").isNull())
    return upsert(view, changes, keys, "removed")


BACKLOG = "subscription_id string, ack_id string, delivered_at timestamp_ntz"


def backlog_step(view: DataFrame, events: DataFrame) -> DataFrame:
    """Removals take rows out; a delivery comes in unless its message waits already."""
    from ..operators.readmodels import backlog

    keys = ["subscription_id", "ack_id"]
    gone = by_ack(events.where(F.col("type").isin(TERMINAL))).select(*keys).distinct()
    left = view.join(gone, keys, "left_anti")
    return left.unionByName(backlog(events).join(left.select(*keys), keys, "left_anti"))


SUBSCRIPTIONS = "topic_id string, subscription_id string"


def subscriptions_step(view: DataFrame, events: DataFrame) -> DataFrame:
    """The index of subscriptions by topic."""
    from ..operators.delivery import subscription_index

    return view.unionByName(subscription_index(events)).distinct()
