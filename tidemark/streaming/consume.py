"""The broker driven by streams: fan-out and dead letters as a journal grows, consumers that pull as time goes, acknowledgements as they come.

Every micro-batch's events are committed under the query's and the batch's name, so a batch that is run again adds nothing.
One query writes to a journal at a time, as there is one writer for each entity; ``together`` runs several steps in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..broker import Broker
from ..storage import hadoop_path


def driven(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, interval_ms: int | None = None) -> StreamingQuery:
    """Calls ``act(rows, batch number)`` for each micro-batch; until the input is used up, or at an interval for ever."""
    w = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if interval_ms is None else w.trigger(processingTime=f"{interval_ms} milliseconds")).start()


def together(*acts: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One step of several, in order."""

    def act(rows: DataFrame, number: int) -> None:
        for a in acts:
            a(rows, number)

    return act


def fan_out(broker: Broker, name: str = "fan-out") -> Callable[[DataFrame, int], None]:
    """For a stream of the journal: delivers the publishes of a batch, and those before it that wait, to their subscriptions."""

    def act(events: DataFrame, number: int) -> None:
        first = events.where(F.col("type") == "MessagePublished").agg(F.min("ordering")).collect()[0][0]
        if first is not None:
            broker.deliver(after=first - 1, batch=f"{name}-{number}")

    return act


def dead_letters(broker: Broker, name: str = "dead-letters") -> Callable[[DataFrame, int], None]:
    """For a stream of the journal: republishes dead letters."""

    def act(events: DataFrame, number: int) -> None:
        if events.where(F.col("type") == "MessageDeadLettered").limit(1).count():
            broker.republish_dead_letters(batch=f"{name}-{number}")

    return act


def acknowledged(broker: Broker, name: str = "acks") -> Callable[[DataFrame, int], None]:
    """For a stream of (subscription_id, ack_id, position): acknowledges what is outstanding; the rest is ignored."""

    def act(requests: DataFrame, number: int) -> None:
        broker.acknowledge(requests, batch=f"{name}-{number}")

    return act


def swept(broker: Broker, name: str = "sweep") -> Callable[[DataFrame, int], None]:
    """For a stream of times (now): ends leases and lives that are over."""

    def act(ticks: DataFrame, number: int) -> None:
        if (now := _latest(ticks)) is not None:
            broker.sweep(now, batch=f"{name}-{number}")
            broker.sweep_ttl(now, batch=f"{name}-ttl-{number}")

    return act


def ticks(spark: SparkSession) -> DataFrame:
    """The clock as a stream of (now) in UTC: a row a second, whether anything happens or not, so an idle consumer looks again."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.to_utc_timestamp("timestamp", F.current_timezone()).cast("timestamp_ntz").alias("now"))


def _latest(rows: DataFrame) -> str | None:
    at = rows.agg(F.max("now")).collect()[0][0]
    return None if at is None else str(at)


def leased(broker: Broker, subscription_id: str, out: str, limit: int | None = None, consumer_id: str | None = None, **credentials: str) -> Callable[[DataFrame, int], None]:
    """For a stream of times (now): each batch leases at most ``limit`` (``stream_batch``) messages and writes them to ``out/v=<batch>``.

    A batch asks again only when the one before it has been written, so a slow reader slows the leases. Several consumers
    of a subscription get disjoint messages. An unknown subscription or refused credentials fail at once.
    """
    spark = broker.spark
    one = spark.createDataFrame([(subscription_id, 0, broker.config.stream_batch if limit is None else limit, consumer_id, credentials.get("authorization"), credentials.get("api_key"))], "subscription_id string, position long, max int, consumer_id string, authorization string, api_key string")
    probe = broker.pull(one.withColumn("max", F.lit(0)).withColumn("consumer_id", F.lit(None).cast("string")), "1970-01-01 00:00:00").first()
    if probe["outcome"] != "Accepted":
        raise LookupError(f"{probe['status']['rpc']}: {subscription_id}")

    def act(rows: DataFrame, number: int) -> None:
        path, name = f"{out}/v={number}", f"consume-{subscription_id}-{consumer_id}-{number}"
        fs, p = hadoop_path(spark, f"{path}/_SUCCESS")
        if (now := _latest(rows)) is None or broker.committed(name) and fs.exists(p):
            return
        shown = lambda reply: reply.select("subscription_id", F.explode("messages").alias("m")).select("subscription_id", "m.*").write.mode("overwrite").parquet(path)
        broker.pull(one, now, batch=name, sink=shown)

    return act


def kept(broker: Broker, name: str = "keep") -> Callable[[DataFrame, int], None]:
    """For a stream of times (now): all that a broker does by itself, in one writer. Ends leases and lives, republishes dead letters, delivers, and takes snapshots when they are due."""

    def act(rows: DataFrame, number: int) -> None:
        if _latest(rows) is not None:
            swept(broker, f"{name}-sweep")(rows, number)
            broker.republish_dead_letters(batch=f"{name}-letters-{number}")
            broker.deliver(batch=f"{name}-deliver-{number}")
            broker.snapshot()

    return act


def background(broker: Broker, checkpoint: str, clock: DataFrame | None = None) -> StreamingQuery:
    """``kept`` every ``sweep_interval_ms``, or once over a clock that is given."""
    return driven(ticks(broker.spark) if clock is None else clock, kept(broker), checkpoint, broker.config.sweep_interval_ms if clock is None else None)


def polling(broker: Broker, subscription_id: str, out: str, checkpoint: str, **consumer: str) -> StreamingQuery:
    """``leased`` every ``poll_interval_ms``: an idle subscription is looked at again at that interval."""
    return driven(ticks(broker.spark), leased(broker, subscription_id, out, **consumer), checkpoint, broker.config.poll_interval_ms)
