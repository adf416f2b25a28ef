"""Snapshots and the events that they make superfluous."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import written
from .subscriptions import outstanding


def numbered(journal: DataFrame, parts: int | None = None) -> DataFrame:
    """The journal with ``seq_nr``: each persistence id's events from 1.

    Events are ranged by (id, ordering), so a busy topic is many partitions. A partition's own counts are numbers within
    it, and what earlier partitions hold of its ids is added: a row for each partition and id that it shares with others.
    """
    parts = parts or int(journal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(journal.repartitionByRange(parts, "persistence_id", "ordering").sortWithinPartitions("persistence_id", "ordering").withColumn("_part", F.spark_partition_id()))
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "persistence_id").orderBy("ordering")))
    held = ranged.groupBy("_part", "persistence_id").agg(F.count(F.lit(1)).alias("_held"))
    before = held.withColumn("_before", F.coalesce(F.sum("_held").over(Window.partitionBy("persistence_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_held")
    return within.join(before, ["_part", "persistence_id"]).select(*journal.columns, (F.col("_n") + F.col("_before")).cast("int").alias("seq_nr"))


def cutoffs(journal: DataFrame, every: int = 100, keep: int = 2) -> DataFrame:
    """(persistence_id, events, last_snapshot, cutoff): snapshots lie at multiples of ``every``; events up to the oldest one kept can go."""
    n = journal.groupBy("persistence_id").agg(F.count(F.lit(1)).alias("events"))
    last = F.floor(F.col("events") / every) * every
    return n.select("persistence_id", "events", last.alias("last_snapshot"), F.greatest(F.lit(0).cast("long"), last - (keep - 1) * every).alias("cutoff"))


def purged(numbered: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What is left of the journal."""
    return numbered.join(cutoffs.select("persistence_id", "cutoff"), "persistence_id").where(F.col("seq_nr") > F.col("cutoff")).drop("cutoff")


def as_events(state: DataFrame) -> DataFrame:
    """A state as events that fold to it: a delivery, then its failures or its lease."""
    pid = F.concat(F.lit("Subscription|"), "subscription_id")
    leased = F.col("lease_state") == "Leased"
    event = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[more.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("message", state.schema["message"].dataType), ("deadline", "timestamp_ntz"), ("attempt", "int"))])
    parts = F.array(event("MessageDelivered", message=F.col("message")), F.when(F.col("attempts") > 0, event("AckDeadlineExpired", attempt=F.col("attempts"))), F.when(leased, event("AckDeadlineModified", deadline=F.col("deadline"))))
    rows = state.select(pid.alias("persistence_id"), "ack_id", F.col("delivered").alias("at"), F.posexplode(parts).alias("k", "e")).where(F.col("e").isNotNull())
    return rows.select((F.col("at") + F.col("k") / 10).alias("ordering"), "persistence_id", "ack_id", F.lit(None).cast("array<string>").alias("ack_ids"), "e.*")


def resumed(state: DataFrame, journal: DataFrame, upto: int) -> DataFrame:
    """The outstanding state from a snapshot at ``upto`` and the events after it."""
    tail = journal.where(F.col("ordering") > upto).select(F.col("ordering").cast("double").alias("ordering"), "persistence_id", "ack_id", "ack_ids", "type", "message", "deadline", "attempt")
    return outstanding(as_events(state).unionByName(tail)).withColumn("delivered", F.floor("delivered").cast("long"))


def recovered(journal: DataFrame, upto: int) -> DataFrame:
    """The outstanding state by way of a snapshot at ``upto``."""
    return resumed(outstanding(journal.where(F.col("ordering") <= upto)), journal, upto)
