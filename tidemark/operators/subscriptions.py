"""Subscriptions: outstanding messages as a closed form of the journal, and decisions over them.

``outstanding`` tables have (subscription_id, ack_id, delivered, message, lease_state, deadline, attempts); ``delivered``
is the ordering of the delivery, which is also the order in which messages are pulled (then by ack_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import ack_id, parsed, valid
from ..functions.messages import expired, instant, plus_ms
from ..schemas import TERMINAL

LEASE_EVENTS = ["MessageLeased", "AckDeadlineModified", "AckDeadlineExpired"]


def by_ack(journal: DataFrame) -> DataFrame:
    """The subscriptions' events by ack id: leases of several ids are taken apart. Ids that hold the separator are skipped."""
    sub = parsed("Subscription", F.col("persistence_id"))
    j = journal.where(F.col("type").isin("MessageDelivered", *LEASE_EVENTS, *TERMINAL))
    return j.select(sub.alias("subscription_id"), F.explode(F.coalesce("ack_ids", F.array("ack_id"))).alias("ack_id"), "ordering", "type", "message", "deadline", "attempt").where(F.col("subscription_id").isNotNull())


def slim(journal: DataFrame) -> DataFrame:
    """``outstanding`` without messages: a hash aggregation over numbers alone, in one shuffle and without a sequential fold.

    A message is outstanding if its last delivery comes after its last removal. What counts of its lease is the last
    lease event after that delivery; of its attempts, the last expiry after it. Events are cut to those after the delivery
    by comparing orderings, as an aggregate can't: the last event of each kind is enough, because an event before the
    delivery leaves no later one of its kind if it is the last.
    """
    e = by_ack(journal).select("subscription_id", "ack_id", "ordering", "type", "deadline", "attempt")
    o, t = F.col("ordering"), F.col("type")
    at = lambda cond: F.max(F.when(cond, o))
    sets, fails = t.isin("MessageLeased", "AckDeadlineModified"), t == "AckDeadlineExpired"
    g = e.groupBy("subscription_id", "ack_id").agg(
        at(t == "MessageDelivered").alias("delivered"), at(t.isin(TERMINAL)).alias("removed"), at(sets).alias("set"), at(fails).alias("failed"),
        F.max_by("deadline", F.when(sets, o)).alias("deadline"), F.max_by("attempt", F.when(fails, o)).alias("attempt"),
    )
    g = g.where(F.col("delivered").isNotNull() & (F.col("removed").isNull() | (F.col("delivered") > F.col("removed"))))
    leased = F.coalesce((F.col("set") > F.col("delivered")) & (F.col("failed").isNull() | (F.col("set") > F.col("failed"))), F.lit(False))
    attempts = F.when(F.col("failed") > F.col("delivered"), F.col("attempt"))
    return g.select("subscription_id", "ack_id", "delivered", F.when(leased, "Leased").otherwise("Available").alias("lease_state"), F.when(leased, F.col("deadline")).alias("deadline"), F.coalesce(attempts, F.lit(0)).alias("attempts"))


def with_messages(state: DataFrame, journal: DataFrame) -> DataFrame:
    """A slim state with the messages of its deliveries: only messages that are outstanding are joined, by the key that the state has been shuffled by."""
    sub = parsed("Subscription", F.col("persistence_id"))
    sent = journal.where(F.col("type") == "MessageDelivered").select(sub.alias("subscription_id"), "ack_id", F.col("ordering").alias("delivered"), "message")
    return state.join(sent, ["subscription_id", "ack_id", "delivered"]).select("subscription_id", "ack_id", "delivered", "message", "lease_state", "deadline", "attempts")


def outstanding(journal: DataFrame) -> DataFrame:
    """The state after all events. Messages meet it after the aggregation, so payloads of removed messages are never aggregated."""
    return with_messages(slim(journal), journal)


def create(commands: DataFrame) -> DataFrame:
    """Create commands with ``rejection``: the first of a subscription wins, whether its topic exists or not."""
    first = commands.groupBy("subscription_id").agg(F.min("ordering").alias("_first"))
    return commands.join(first, "subscription_id").select(*commands.columns, F.when(F.col("ordering") != F.col("_first"), "SubscriptionAlreadyExists").alias("rejection"))


def record_delivery(deliveries: DataFrame, existing: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new deliveries, rejected ones): a message that is outstanding, or comes twice, is delivered once.

    ``deliveries``: (subscription_id, ack_id, ordering, ...); ``existing``: (subscription_id).
    """
    known = deliveries.join(existing.select("subscription_id").distinct(), "subscription_id", "left_semi")
    fresh = known.join(state, ["subscription_id", "ack_id"], "left_anti")
    first = fresh.groupBy("subscription_id", "ack_id").agg(F.min("ordering").alias("ordering"))
    lost = deliveries.join(existing, "subscription_id", "left_anti").withColumn("rejection", F.lit("SubscriptionNotFound"))
    return fresh.join(first, ["subscription_id", "ack_id", "ordering"], "left_semi").dropDuplicates(["subscription_id", "ack_id"]), lost


def pull(state: DataFrame, limit: int, now) -> DataFrame:
    """The first ``limit`` messages of each subscription that are available and haven't expired; none for a negative limit.

    Ranks are taken by group limits before the shuffle, so a large backlog does not travel.
    """
    ready = state.where((F.col("lease_state") == "Available") & ~expired(F.col("message.expire_time"), now))
    order = Window.partitionBy("subscription_id").orderBy("delivered", "ack_id")
    return ready.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(0, limit))


def lease(state: DataFrame, limit: int, now, ack_deadline_ms: int = 30_000) -> DataFrame:
    """(subscription_id, ack_ids, deadline): one lease event for each subscription that has messages to pull."""
    taken = pull(state, limit, now)
    return taken.groupBy("subscription_id").agg(F.sort_array(F.collect_list(F.struct("position", "ack_id"))).alias("x")).select("subscription_id", F.col("x.ack_id").alias("ack_ids"), plus_ms(instant(now), ack_deadline_ms).alias("deadline"))


def assigned(state: DataFrame, requests: DataFrame, now) -> DataFrame:
    """(subscription_id, position, ack_id, rank, message): what each of several pulls gets, disjoint by their positions.

    ``requests``: (subscription_id, position, max). The first request of a subscription takes its first ``max`` messages,
    the next one those after them. No subscription is ranked further than its requests ask for in sum.
    """
    asked = requests.where(F.col("max") > 0)
    order = Window.partitionBy("subscription_id").orderBy("position")
    spans = asked.withColumn("upto", F.sum("max").over(order)).select("subscription_id", "position", "upto", (F.col("upto") - F.col("max")).alias("after"))
    most = spans.agg(F.max("upto")).collect()[0][0] or 0
    ranked = pull(state.join(spans.select("subscription_id").distinct(), "subscription_id", "left_semi"), most, now).select("subscription_id", F.col("position").alias("rank"), "ack_id", "message")
    return ranked.join(spans, "subscription_id").where((F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("upto"))).select("subscription_id", "position", "ack_id", "rank", "message")


def split_acks(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests (subscription_id, ack_id, position, ...) with ``known``: whether the ack id is outstanding.

    Of a repeated id one applies, the first; blank ids are unknown.
    """
    known = state.select("subscription_id", "ack_id", F.lit(True).alias("_there"))
    first = requests.groupBy("subscription_id", "ack_id").agg(F.min("position").alias("_first"))
    r = requests.join(known, ["subscription_id", "ack_id"], "left").join(first, ["subscription_id", "ack_id"], "left")
    return r.select(*requests.columns, (F.coalesce("_there", F.lit(False)) & (F.col("position") == F.col("_first")) & valid(F.col("ack_id"))).alias("known"))


def batch_reply(split: DataFrame, *request: str) -> DataFrame:
    """(subscription_id, [request columns,] applied, unknown): ack ids in the order of the request. A request is small, so are its lists."""
    ids = lambda flag: F.transform(F.sort_array(F.collect_list(F.when(F.col("known") == flag, F.struct("position", "ack_id")))), lambda x: x["ack_id"])
    return split.groupBy("subscription_id", *request).agg(ids(F.lit(True)).alias("applied"), ids(F.lit(False)).alias("unknown"))


def acknowledge(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests with ``event`` or ``rejection``. An available or overdue message can be acknowledged as well."""
    return split_acks(requests, state).withColumns({"event": F.when(F.col("known"), "MessageAcknowledged"), "rejection": F.when(~F.col("known"), "UnknownAckId")})


def modify_deadline(requests: DataFrame, state: DataFrame, now) -> DataFrame:
    """Requests (.., deadline_ms) with event, attempt, deadline or rejection. A deadline of 0 or less gives the message back, with attempt 0."""
    s = split_acks(requests, state)
    back = F.col("deadline_ms") <= 0
    return s.withColumns({
        "event": F.when(F.col("known"), F.when(back, "AckDeadlineExpired").otherwise("AckDeadlineModified")),
        "attempt": F.when(F.col("known") & back, 0),
        "deadline": F.when(F.col("known") & ~back, plus_ms(instant(now), F.col("deadline_ms"))),
        "rejection": F.when(~F.col("known"), "UnknownAckId"),
    })


def expire_deadlines(candidates: DataFrame, state: DataFrame, now, max_attempts: int = 5) -> DataFrame:
    """Events of the candidates (subscription_id, ack_id) whose lease is over by the authoritative state; others are left alone. A slim state gives events without messages."""
    due = state.join(candidates.select("subscription_id", "ack_id").distinct(), ["subscription_id", "ack_id"], "left_semi").where((F.col("lease_state") == "Leased") & (F.col("deadline") <= instant(now)))
    attempt = F.col("attempts") + 1
    dead = F.lit(max_attempts > 0) & (attempt >= max_attempts)
    return due.select("subscription_id", "ack_id", F.when(dead, "MessageDeadLettered").otherwise("AckDeadlineExpired").alias("event"), attempt.alias("attempt"), *([F.when(dead, F.col("message")).alias("message")] if "message" in state.columns else []))


def expire_messages(candidates: DataFrame, state: DataFrame, now) -> DataFrame:
    """MessageExpired for the candidates that are outstanding, leased or not, and past their time."""
    due = state.join(candidates.select("subscription_id", "ack_id").distinct(), ["subscription_id", "ack_id"], "left_semi").where(expired(F.col("message.expire_time"), now))
    return due.select("subscription_id", "ack_id", F.lit("MessageExpired").alias("event"))


def exists(subscription_ids: DataFrame, journal: DataFrame) -> DataFrame:
    """The ids (subscription_id) that have been created."""
    made = journal.where(F.col("type") == "SubscriptionCreated").select("subscription_id")
    return subscription_ids.join(made, "subscription_id", "left_semi")


__all__ = ["ack_id", "acknowledge", "assigned", "batch_reply", "by_ack", "create", "exists", "expire_deadlines", "expire_messages", "lease", "modify_deadline", "outstanding", "pull", "record_delivery", "slim", "split_acks", "with_messages"]
