"""Topics: lifecycle decisions over commands, state, and idempotent publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dedup import deduplicated


def active_periods(commands: DataFrame) -> DataFrame:
    """(topic_id, created, deleted): the first Create of every topic and the first Delete after it.

    A topic that was deleted stays used: it is never created again.
    """
    created = commands.where(F.col("kind") == "Create").groupBy("topic_id").agg(F.min("ordering").alias("created"))
    deletes = commands.where(F.col("kind") == "Delete").select("topic_id", F.col("ordering").alias("at"))
    first = deletes.join(created, "topic_id").where(F.col("at") > F.col("created")).groupBy("topic_id").agg(F.min("at").alias("deleted"))
    return created.join(first, "topic_id", "left")


def decide(commands: DataFrame) -> DataFrame:
    """Every command with ``rejection``: TopicAlreadyExists, TopicNotFound, or null for an accepted one.

    Publishes are decided here but for deduplication, see ``deduplicated``.
    """
    c = commands.join(active_periods(commands), "topic_id", "left")
    o = F.col("ordering")
    active = F.coalesce((o > F.col("created")) & (F.col("deleted").isNull() | (o <= F.col("deleted"))), F.lit(False))
    reject = F.when((F.col("kind") == "Create") & (o != F.col("created")), "TopicAlreadyExists").when((F.col("kind") != "Create") & ~active, "TopicNotFound")
    return c.select(*commands.columns, reject.alias("rejection"))


def events_of(decided: DataFrame) -> DataFrame:
    """The journal events of accepted commands, publishes included."""
    kinds = {"Create": "TopicCreated", "Publish": "MessagePublished", "Delete": "TopicDeleted", "Update": "TopicLabelsUpdated"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    return decided.where(F.col("rejection").isNull()).select("ordering", F.concat(F.lit("Topic|"), "topic_id").alias("persistence_id"), name.alias("type"), "topic_id", "labels", "message")


def state(decided: DataFrame) -> DataFrame:
    """(topic_id, labels, deleted) of every topic that was created; an update replaces all labels."""
    a = decided.where(F.col("rejection").isNull())
    sets = F.col("kind").isin("Create", "Update")
    return a.groupBy("topic_id").agg(F.max_by(F.when(sets, F.struct("labels")), F.when(sets, F.col("ordering"))).alias("l"), F.bool_or(F.col("kind") == "Delete").alias("deleted")).select("topic_id", F.coalesce("l.labels", F.create_map().cast("map<string,string>")).alias("labels"), "deleted")


def snapshot(state: DataFrame) -> DataFrame:
    """(topic_id, labels) of active topics."""
    return state.where(~F.col("deleted")).select("topic_id", "labels")


__all__ = ["active_periods", "decide", "deduplicated", "events_of", "snapshot", "state"]
