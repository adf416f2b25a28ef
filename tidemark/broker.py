"""The broker's verbs over a stored journal: requests in, replies and committed events out, with the status of either interface.

There is no server here. A verb takes a DataFrame of requests, decides them against the journal's state, commits the events
of those that it accepts, and returns one row for each request. Decisions are written to the shared folder before their
events are committed, so a reply never depends on a journal that has gone on. With a ``batch`` name a verb's events are
committed once, however often it is run again. Status codes come from one table, so REST and RPC agree except where the
broker's interfaces differ.

With authentication on, requests carry ``authorization`` or ``api_key``; ids in requests and replies are then the tenant's
own, and those in the journal have the tenant before them. Without it ids stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .config import BrokerConfig
from .functions import auth, ids, messages
from .operators import consumers, deadletter, delivery, metrics, readmodels, retention, subscriptions, tenancy, topics
from .schemas import JOURNAL, create_tables
from .sources import journal as store
from .storage import hadoop_path, written

#: Outcome -> (REST status, RPC status).
STATUS = {
    "Accepted": (200, "OK"), "Created": (201, "OK"), "Published": (202, "OK"), "Deleted": (204, "OK"),
    "TopicNotFound": (404, "NOT_FOUND"), "SubscriptionNotFound": (404, "NOT_FOUND"), "UnknownAckId": (404, "NOT_FOUND"),
    "TopicAlreadyExists": (409, "ALREADY_EXISTS"), "SubscriptionAlreadyExists": (409, "ALREADY_EXISTS"),
    "ValidationError": (400, "INVALID_ARGUMENT"), "Unauthenticated": (401, "UNAUTHENTICATED"), "Forbidden": (403, "PERMISSION_DENIED"), "Unavailable": (503, "UNAVAILABLE"),
}

CALLS = "subscription_id string, consumer_id string, at timestamp_ntz"
_OK = {"Create": "Created", "Publish": "Published", "Delete": "Deleted", "Update": "Accepted"}


def status(outcome: Column) -> Column:
    """(rest, rpc) of an outcome; what isn't known is an internal error."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else x for k, (rest, rpc) in STATUS.items() for x in (k, F.struct(F.lit(rest).alias("rest"), F.lit(rpc).alias("rpc")))])
    return F.coalesce(F.try_element_at(table, outcome), F.struct(F.lit(500).alias("rest"), F.lit("INTERNAL").alias("rpc")))


def event(kind: Column | str, pid: Column, **fields: Column) -> list[Column]:
    """A journal row's columns but for its ordering; fields that an event doesn't have are null."""
    given = {"type": F.lit(kind) if isinstance(kind, str) else kind, "persistence_id": pid, **fields}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(JOURNAL) if f.name != "ordering"]


def _with(df: DataFrame, **defaults: str) -> DataFrame:
    """Columns that requests may leave out, as nulls of a type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns})


class Broker:
    def __init__(self, spark: SparkSession, path: str, config: BrokerConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or BrokerConfig()
        if self.config.migrate_on_start and self.config.database != BrokerConfig.database:
            create_tables(spark, self.config.database, self.config.migrate_max_wait_ms)

    # The journal

    def journal(self) -> DataFrame:
        return store.read(self.spark, self.path)

    def commit(self, events: DataFrame, batch: str | None = None) -> bool:
        """Appends events that have their orderings; False if the batch had been committed."""
        return store.append(events, self.path, batch)

    def committed(self, batch: str) -> bool:
        return any(b == batch for _, _, b in store.commits(self.spark, self.path))

    def record(self, events: DataFrame, order: list[str], batch: str | None = None) -> int:
        """Numbers events (without ``ordering``) after the journal's last one, in the order of some columns, and commits them; how many.

        Each partition's events are numbered on their own, and the partitions' counts, a row for each, are added before.
        """
        if batch is not None and self.committed(batch):
            return 0
        k = F.monotonically_increasing_id()
        staged = written(events.orderBy(*order).withColumns({"_part": F.shiftright(k, 33).cast("int"), "_k": k.bitwiseAND(F.lit((1 << 33) - 1))}))
        counts = {r["_part"]: r["n"] for r in staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return 0
        at, before = store.head(self.spark, self.path) + 1, []
        for part in sorted(counts):
            before.append((part, at))
            at += counts[part]
        bases = self.spark.createDataFrame(before, "_part int, _base long")
        columns = StructType.fromDDL(JOURNAL).names
        self.commit(staged.join(F.broadcast(bases), "_part").withColumn("ordering", F.col("_base") + F.col("_k")).select(*columns), batch)
        return sum(counts.values())

    def state(self) -> DataFrame:
        """Outstanding messages, from the latest snapshot and the events after it."""
        known = store.snapshots(self.spark, f"{self.path}/_snapshots")
        if not known:
            return subscriptions.outstanding(self.journal())
        snap = store.latest_snapshot(self.spark, f"{self.path}/_snapshots").drop("at")
        return retention.resumed(snap, self.journal(), known[-1])

    def snapshot(self) -> int | None:
        """Stores the state once ``snapshot_every`` orderings have passed, keeps the last ``keep_snapshots``, and purges what the oldest of them covers."""
        folder, head = f"{self.path}/_snapshots", store.head(self.spark, self.path)
        known = store.snapshots(self.spark, folder)
        if head < 0 or known and head - known[-1] < self.config.snapshot_every:
            return None
        store.write_snapshot(written(self.state()), folder, head, self.config.keep_snapshots)
        store.purge(self.spark, self.path, store.snapshots(self.spark, folder)[0])
        return head

    # Who asks

    def admitted(self, requests: DataFrame, admin: Column | bool = False) -> DataFrame:
        """Requests with their tenant and ``refusal``: Unauthenticated, or Forbidden where ``admin`` holds and the key lacks that scope."""
        if not self.config.auth_enabled:
            return requests.withColumns({"tenant": F.lit(None).cast("string"), "refusal": F.lit(None).cast("string")})
        r = _with(requests, authorization="string", api_key="string").withColumn("token", auth.token(F.col("authorization"), F.col("api_key")))
        p = auth.principals(r, list(self.config.auth_keys))
        needs = admin if isinstance(admin, Column) else F.lit(admin)
        refusal = F.when(F.col("tenant").isNull(), "Unauthenticated").when(needs & ~auth.allowed(F.col("scopes"), "admin"), "Forbidden")
        return p.withColumn("refusal", refusal).drop("authorization", "api_key", "token", "scopes", "key_position")

    def _checked(self, requests: DataFrame, columns: list[str], admin: Column | bool = False) -> DataFrame:
        """Admitted requests with internal ids in ``columns`` (the external ones as ext_<column>); ids that aren't valid are refused as well."""
        r = self.admitted(requests, admin)
        bad = F.lit(False)
        for c in columns:
            bad = bad | ~F.coalesce(ids.valid_external(F.col("tenant"), F.col(c)), F.lit(False))
        r = r.withColumn("refusal", F.coalesce("refusal", F.when(bad, "ValidationError")))
        return r.withColumns({f"ext_{c}": F.col(c) for c in columns} | {c: ids.qualify(F.col("tenant"), F.col(c)) for c in columns})

    # Topics

    def _topics(self) -> DataFrame:
        """The journal's topic events as the accepted commands that they were."""
        j = self.journal().where(F.col("type").isin("TopicCreated", "TopicDeleted", "TopicLabelsUpdated"))
        kind = F.when(F.col("type") == "TopicCreated", "Create").when(F.col("type") == "TopicDeleted", "Delete").otherwise("Update")
        return j.select("ordering", ids.parsed("Topic", F.col("persistence_id")).alias("topic_id"), kind.alias("kind"), "labels")

    def _decided(self, commands: DataFrame) -> DataFrame:
        """Checked commands (topic_id, kind, position, labels, refusal, ...) with ``rejection``, after the journal's topic events."""
        fine = commands.where(F.col("refusal").isNull())
        old = self._topics()
        new = fine.withColumn("ordering", F.lit(store.head(self.spark, self.path) + 1) + F.col("position"))
        every = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        decided = topics.decide(every).where("_new").select(*commands.columns, "rejection")
        return decided.unionByName(commands.where(F.col("refusal").isNotNull()).withColumn("rejection", F.col("refusal")))

    def topic_command(self, commands: DataFrame, batch: str | None = None) -> DataFrame:
        """Create, Update and Delete (topic_id, kind, labels, position) with outcome and status. They need the admin scope."""
        d = written(self._decided(self._checked(_with(commands, labels="map<string,string>"), ["topic_id"], admin=True)))
        kinds = F.when(F.col("kind") == "Create", "TopicCreated").when(F.col("kind") == "Delete", "TopicDeleted").otherwise("TopicLabelsUpdated")
        labels = F.when(F.col("kind") != "Delete", F.coalesce("labels", F.create_map().cast("map<string,string>")))
        self.record(d.where(F.col("rejection").isNull()).select("position", *event(kinds, ids.persistence_id("Topic", F.col("topic_id")), topic_id=F.col("topic_id"), labels=labels)), ["position"], batch)
        ok = F.element_at(F.create_map(*[F.lit(x) for kv in _OK.items() for x in kv]), F.col("kind"))
        return self._reply(d.withColumn("outcome", F.coalesce("rejection", ok)), F.col("ext_topic_id").alias("topic_id"), "kind", "position")

    def publish(self, requests: DataFrame, now: str, batch: str | None = None) -> DataFrame:
        """(topic_id, message_id, payload, attributes, ttl_seconds, idempotency_key, position) with outcome, status, the effective message id, whether it was a duplicate, and its expiry.

        A TTL, or else the default one, gives the expiry. Of the journal only those publishes take part in deduplication
        that lie within the window: what is older can't be the anchor of a new one.
        """
        r = _with(requests, attributes="map<string,string>", ttl_seconds="long", idempotency_key="string").withColumn("kind", F.lit("Publish"))
        d = self._decided(self._checked(r, ["topic_id"]))
        at = messages.instant(now)
        expiry = messages.expire_at(at, F.col("ttl_seconds") * 1000, self.config.default_ttl_ms)
        message = F.struct("message_id", F.col("payload").cast("binary").alias("payload"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), at.alias("publish_time"), expiry.alias("expire_time"), F.nullif("idempotency_key", F.lit("")).alias("idempotency_key"))
        d = d.withColumn("message", message)
        new = d.where(F.col("rejection").isNull()).select("topic_id", "message.message_id", "message.publish_time", F.col("message.idempotency_key").alias("key"), "position")
        recent = self.journal().where((F.col("type") == "MessagePublished") & F.col("message.idempotency_key").isNotNull() & (F.col("message.publish_time") >= messages.plus_ms(at, -self.config.dedup_window_ms)))
        old = recent.select(ids.parsed("Topic", F.col("persistence_id")).alias("topic_id"), "message.message_id", "message.publish_time", F.col("message.idempotency_key").alias("key"), F.lit(None).cast(new.schema["position"].dataType).alias("position"))
        both = written(old.unionByName(new) if self.config.dedup_window_ms else new)
        found = topics.deduplicated(both, self.config.dedup_window_ms).where(F.col("position").isNotNull()).select("position", "original_id", "deduplicated")
        d = written(d.join(found, "position", "left"))
        self.record(d.where(F.col("rejection").isNull() & ~F.col("deduplicated")).select("position", *event("MessagePublished", ids.persistence_id("Topic", F.col("topic_id")), message=F.col("message"))), ["position"], batch)
        return self._reply(d.withColumn("outcome", F.coalesce("rejection", F.lit("Published"))), F.col("ext_topic_id").alias("topic_id"), "position", F.col("original_id").alias("message_id"), "deduplicated", F.when(F.col("rejection").isNull(), F.col("message.expire_time")).alias("expire_time"))

    def get_topic(self, tenant: str | None = None) -> DataFrame:
        """(topic_id, labels) of a tenant's active topics."""
        return tenancy.owned(topics.snapshot(topics.state(topics.decide(self._topics()))), tenant, ["topic_id"])

    # Subscriptions

    def _reply(self, decided: DataFrame, *columns) -> DataFrame:
        return decided.select(*columns, "outcome", status(F.col("outcome")).alias("status"))

    def existing(self) -> DataFrame:
        """(subscription_id) of all subscriptions."""
        return self.journal().where(F.col("type") == "SubscriptionCreated").select("subscription_id").distinct()

    def create_subscription(self, commands: DataFrame, batch: str | None = None) -> DataFrame:
        """(subscription_id, topic_id, position) with outcome and status; the topic need not exist."""
        r = self._checked(commands, ["subscription_id", "topic_id"])
        fine = r.where(F.col("refusal").isNull()).withColumn("ordering", F.lit(store.head(self.spark, self.path) + 1) + F.col("position"))
        old = self.journal().where(F.col("type") == "SubscriptionCreated").select("subscription_id", "ordering")
        d = subscriptions.create(old.unionByName(fine, allowMissingColumns=True)).where(F.col("position").isNotNull())
        d = written(d.unionByName(r.where(F.col("refusal").isNotNull()).withColumn("rejection", F.col("refusal")), allowMissingColumns=True))
        self.record(d.where(F.col("rejection").isNull()).select("position", *event("SubscriptionCreated", ids.persistence_id("Subscription", F.col("subscription_id")), topic_id=F.col("topic_id"), subscription_id=F.col("subscription_id"))), ["position"], batch)
        return self._reply(d.withColumn("outcome", F.coalesce("rejection", F.lit("Created"))), F.col("ext_subscription_id").alias("subscription_id"), F.col("ext_topic_id").alias("topic_id"), "position")

    def deliver(self, after: int = -1, batch: str | None = None) -> int:
        """Delivers publishes after an ordering to the subscriptions that their topics had before them; how many deliveries. What was delivered before isn't again."""
        j = self.journal()
        due = j.where((F.col("type") != "MessagePublished") | (F.col("ordering") > after))
        seen = subscriptions.by_ack(j).where(F.col("type") == "MessageDelivered").select("subscription_id", "ack_id")
        fresh, _ = subscriptions.record_delivery(delivery.fan_out(due), delivery.subscription_index(j).select("subscription_id"), seen)
        rows = fresh.select(F.col("ordering").alias("_at"), *event("MessageDelivered", ids.persistence_id("Subscription", F.col("subscription_id")), ack_id=F.col("ack_id"), message=F.col("message")))
        return self.record(rows, ["_at", "ack_id"], batch)

    def pull(self, requests: DataFrame, now: str, batch: str | None = None, limit: int | None = None, sink=None) -> DataFrame:
        """(subscription_id, position, max, consumer_id) with outcome, status and messages, which are leased from now on.

        Several pulls of a subscription get disjoint messages. Without ``max`` a pull asks for ``default_pull`` messages
        (or ``limit``); 0 or less leases nothing. A named consumer counts as seen, whether its subscription exists or not.
        ``sink`` is called with the replies before they are committed.
        """
        r = self._checked(_with(requests, max="int", consumer_id="string"), ["subscription_id"])
        r = r.withColumn("max", F.coalesce("max", F.lit(self.config.default_pull if limit is None else limit)))
        r = written(r.join(self.existing().withColumn("_there", F.lit(True)), "subscription_id", "left").withColumn("rejection", F.coalesce("refusal", F.when(F.col("_there").isNull(), "SubscriptionNotFound"))).drop("_there"))
        taken = written(subscriptions.assigned(self.state(), r.where(F.col("rejection").isNull()).select("subscription_id", "position", "max"), now))
        shown = F.struct("rank", "ack_id", F.col("message.message_id").alias("message_id"), messages.text(F.col("message.payload")).alias("payload"), F.col("message.attributes").alias("attributes"), messages.iso(F.col("message.publish_time")).alias("publish_time"))
        each = taken.groupBy("subscription_id", "position").agg(F.array_sort(F.collect_list(shown), lambda x, y: x["rank"] - y["rank"]).alias("messages"))
        none = F.array().cast(each.schema["messages"].dataType)
        d = written(r.join(each, ["subscription_id", "position"], "left").withColumn("messages", F.coalesce("messages", none)).withColumn("outcome", F.coalesce("rejection", F.lit("Accepted"))))
        reply = self._reply(d, F.col("ext_subscription_id").alias("subscription_id"), "position", "messages")
        if sink is not None:
            sink(reply)
        until = messages.plus_ms(messages.instant(now), self.config.ack_deadline_ms)
        rows = d.where(F.size("messages") > 0).select("position", *event("MessageLeased", ids.persistence_id("Subscription", F.col("subscription_id")), ack_ids=F.col("messages.ack_id"), deadline=until))
        self.record(rows, ["position"], batch)
        self.touch(r.where(F.coalesce("refusal", F.lit("")) != "Unauthenticated").select("subscription_id", "consumer_id", messages.instant(now).alias("at")))
        return reply

    def touch(self, calls: DataFrame) -> None:
        """Notes calls (subscription_id, consumer_id, at) of named consumers."""
        calls.where(ids.valid(F.col("consumer_id"))).write.mode("append").parquet(f"{self.path}/_calls")

    def calls(self) -> DataFrame:
        fs, p = hadoop_path(self.spark, f"{self.path}/_calls")
        return self.spark.read.schema(CALLS).parquet(f"{self.path}/_calls") if fs.exists(p) else self.spark.createDataFrame([], CALLS)

    def _split(self, requests: DataFrame) -> DataFrame:
        """Requests on ack ids with refusal, whether the subscription is there, and ``known``."""
        r = self._checked(requests, ["subscription_id"]).join(self.existing().withColumn("there", F.lit(True)), "subscription_id", "left")
        return written(subscriptions.split_acks(r, self.state()).withColumn("known", F.col("known") & F.col("refusal").isNull()))

    def _acks(self, split: DataFrame, first: str, second: str, missing: bool) -> DataFrame:
        """A reply for each subscription of the requests, with the two lists of ack ids and the outcome."""
        lists = subscriptions.batch_reply(split, "ext_subscription_id", "refusal", "there").withColumnsRenamed({"applied": first, "unknown": second})
        absent = F.when(F.col("there").isNull(), "SubscriptionNotFound") if missing else F.lit(None).cast("string")
        return self._reply(lists.withColumn("outcome", F.coalesce("refusal", absent, F.lit("Accepted"))), F.col("ext_subscription_id").alias("subscription_id"), first, second)

    def acknowledge(self, requests: DataFrame, rpc: bool = False, batch: str | None = None) -> DataFrame:
        """(subscription_id, ack_id, position) -> (subscription_id, applied, unknown, outcome, status); removes what is outstanding.

        REST accepts acks on an unknown subscription, where all ids are unknown; RPC does not.
        """
        s = self._split(requests)
        self.record(s.where("known").select("position", *event("MessageAcknowledged", ids.persistence_id("Subscription", F.col("subscription_id")), ack_id=F.col("ack_id"))), ["position", "ack_id"], batch)
        return self._acks(s, "applied", "unknown", rpc)

    def modify_deadline(self, requests: DataFrame, now: str, batch: str | None = None) -> DataFrame:
        """(subscription_id, ack_id, position, deadline_ms) -> (subscription_id, modified, unknown, outcome, status). 0 or less gives a message back."""
        s = self._split(requests)
        back = F.col("deadline_ms") <= 0
        kind = F.when(back, "AckDeadlineExpired").otherwise("AckDeadlineModified")
        until = F.when(~back, messages.plus_ms(messages.instant(now), F.col("deadline_ms")))
        self.record(s.where("known").select("position", *event(kind, ids.persistence_id("Subscription", F.col("subscription_id")), ack_id=F.col("ack_id"), deadline=until, attempt=F.when(back, 0))), ["position", "ack_id"], batch)
        return self._acks(s, "modified", "unknown", True)

    # What time does

    def sweep(self, now: str, batch: str | None = None) -> int:
        """Ends leases that are over: back to their queue, or to the dead letters after ``max_delivery_attempts``; how many."""
        state = self.state()
        over = subscriptions.expire_deadlines(state.where(F.col("lease_state") == "Leased").select("subscription_id", "ack_id"), state, now, self.config.max_delivery_attempts)
        return self.record(over.select(*event(F.col("event"), ids.persistence_id("Subscription", F.col("subscription_id")), ack_id=F.col("ack_id"), message=F.col("message"), attempt=F.col("attempt"))), ["persistence_id", "ack_id"], batch)

    def sweep_ttl(self, now: str, batch: str | None = None) -> int:
        """Removes messages that are past their time; how many."""
        state = self.state()
        past = subscriptions.expire_messages(state.select("subscription_id", "ack_id"), state, now)
        return self.record(past.select(*event("MessageExpired", ids.persistence_id("Subscription", F.col("subscription_id")), ack_id=F.col("ack_id"))), ["persistence_id", "ack_id"], batch)

    def republish_dead_letters(self, batch: str | None = None) -> DataFrame:
        """Publishes dead letters to the dead-letter topic, each once: (message_id, source_subscription, attempt, outcome). Without that topic they are dropped."""
        topic, j = self.config.dead_letter_topic, self.journal()
        sent = j.where((F.col("type") == "MessagePublished") & (F.col("persistence_id") == f"Topic|{topic}")).select("message.message_id")
        new = deadletter.unsent(deadletter.dead_letters(j, topic), sent)
        d = written(deadletter.routed(new, topics.snapshot(topics.state(topics.decide(self._topics())))))
        self.record(d.where(F.col("outcome") == "Published").select(*event("MessagePublished", ids.persistence_id("Topic", F.col("topic_id")), message=F.col("message"))), ["message.message_id"], batch)
        return d.select("message.message_id", "source_subscription", "attempt", "outcome")

    # What can be seen

    def list_subscriptions(self, now: str, tenant: str | None = None) -> DataFrame:
        j = self.journal()
        stats = readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))
        return tenancy.owned(readmodels.subscription_listing(stats, now), tenant, ["subscription_id", "topic_id"])

    def list_topics(self, tenant: str | None = None) -> DataFrame:
        return tenancy.owned(readmodels.topic_listing(readmodels.topic_stats(self.journal())), tenant, ["topic_id"])

    def metrics(self, now: str, calls: DataFrame | None = None) -> DataFrame:
        """The metrics of all tenants, for anyone."""
        j = self.journal()
        stats = readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))
        active = consumers.active(self.calls() if calls is None else calls, now, self.config.activity_window_ms)
        return metrics.page(readmodels.subscription_listing(stats, now), readmodels.topic_listing(readmodels.topic_stats(j)), active)

    def health(self) -> tuple[int, str]:
        """Whether this process lives."""
        return 200, "UP"

    def ready(self) -> tuple[int, str]:
        """Whether the journal can be read: (200, "UP") or (503, "DOWN")."""
        try:
            store.commits(self.spark, self.path)
            self.journal().limit(1).collect()
            return 200, "UP"
        except Exception:
            return 503, "DOWN"
