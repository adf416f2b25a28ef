"""The broker's queries over the tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import AuthKey
from .functions import auth, codec, exposition, ids, messages
from .operators import consumers, deadletter, delivery, metrics, readmodels, retention, subscriptions, tenancy, topics
from .plans import synthetic
from .plans.synthetic import NOW, journal

DAY_MS = 86_400_000
DEDUP_DAYS = 3


def _parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _flat(state: DataFrame) -> DataFrame:
    return state.select("subscription_id", "ack_id", F.col("message.message_id").alias("message_id"), "lease_state", "deadline", "attempts")


# Statistics and read models


def topic_stats(spark, sf):
    return readmodels.topic_stats(journal(spark, sf))


def subscription_stats(spark, sf):
    j = journal(spark, sf)
    return readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))


def subscription_listing_age(spark, sf):
    return readmodels.subscription_listing(subscription_stats(spark, sf), NOW)


def topic_listing(spark, sf):
    return readmodels.topic_listing(topic_stats(spark, sf))


def outstanding_state(spark, sf):
    return _flat(subscriptions.outstanding(journal(spark, sf)))


def backlog_view(spark, sf):
    return readmodels.backlog(journal(spark, sf))


def lease_index(spark, sf):
    return readmodels.leases(journal(spark, sf))


def expiry_index(spark, sf):
    return readmodels.expiring(journal(spark, sf))


def subscription_index(spark, sf):
    return delivery.subscription_index(journal(spark, sf))


def subscriptions_per_topic(spark, sf):
    return delivery.per_topic(subscription_index(spark, sf))


def fanout_delivery(spark, sf):
    return delivery.fan_out(journal(spark, sf)).select("subscription_id", "ack_id", "ordering", F.col("message.message_id").alias("message_id"))


# Pulls, acknowledgements, sweeps


def pull_topk(spark, sf):
    return subscriptions.pull(subscriptions.outstanding(journal(spark, sf)), 10, NOW).select("subscription_id", "position", "ack_id", messages.text(F.col("message.payload")).alias("payload"), messages.iso(F.col("message.publish_time")).alias("publish_time"))


def pull_twice_disjoint(spark, sf):
    """Two pulls of every subscription, of seven messages and of five: the second goes on where the first ends."""
    asked = subscription_index(spark, sf).select("subscription_id", F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit(7).alias("max")), F.struct(F.lit(1).alias("position"), F.lit(5).alias("max")))).alias("r")).select("subscription_id", "r.*")
    return subscriptions.assigned(subscriptions.outstanding(journal(spark, sf)), asked, NOW).select("subscription_id", "position", "ack_id", "rank")


def lease_events(spark, sf):
    return subscriptions.lease(subscriptions.outstanding(journal(spark, sf)), 100, NOW).select("subscription_id", F.concat_ws(",", "ack_ids").alias("ack_ids"), "deadline")


def _requests(spark, sf):
    """Every event's ack id in each of its topic's three subscriptions; every third twice, and a blank id after every fifth. Fifty events are one request."""
    e = synthetic.events(spark, sf).select("event_type", "event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    e = e.select("*", F.explode(F.array(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1), F.when(F.col("event_id") % 5 == 0, 2))).alias("again")).where(F.col("again").isNotNull())
    sub = F.format_string("s-%s-%d", "event_type", "i")
    ack = F.when(F.col("again") == 2, F.lit(" ")).otherwise(F.concat(sub, F.lit(":m-"), F.col("event_id").cast("string")))
    return e.select(sub.alias("subscription_id"), ack.alias("ack_id"), (F.col("event_id") * 9 + F.col("i") * 3 + F.col("again")).alias("position"), (F.col("event_id") % 5 * 10_000).alias("deadline_ms"), F.expr("event_id div 50").alias("request"))


def ack_applied(spark, sf):
    r = subscriptions.acknowledge(_requests(spark, sf), subscriptions.slim(journal(spark, sf)))
    return r.where(F.col("event").isNotNull()).select("subscription_id", "ack_id", "position", "event")


def ack_unknown(spark, sf):
    r = subscriptions.acknowledge(_requests(spark, sf), subscriptions.slim(journal(spark, sf)))
    return r.where(F.col("rejection").isNotNull()).select("subscription_id", "ack_id", "position", "rejection")


def ack_batch_reply(spark, sf):
    r = subscriptions.batch_reply(subscriptions.split_acks(_requests(spark, sf), subscriptions.slim(journal(spark, sf))), "request")
    return r.select("subscription_id", "request", F.concat_ws(",", "applied").alias("applied"), F.size("unknown").cast("long").alias("n_unknown"))


def modify_deadline(spark, sf):
    r = subscriptions.modify_deadline(_requests(spark, sf), subscriptions.slim(journal(spark, sf)), NOW)
    return r.select("subscription_id", "ack_id", "position", "event", "attempt", "deadline", "rejection")


def redelivery_sweep(spark, sf):
    j = journal(spark, sf)
    swept = subscriptions.expire_deadlines(readmodels.overdue(readmodels.leases(j), NOW), subscriptions.slim(j), NOW, max_attempts=5)
    return swept.select("subscription_id", "ack_id", "event", "attempt")


def dead_letter_candidates(spark, sf):
    j = journal(spark, sf)
    swept = subscriptions.expire_deadlines(readmodels.overdue(readmodels.leases(j), NOW), subscriptions.outstanding(j), NOW, max_attempts=1)
    return swept.where(F.col("event") == "MessageDeadLettered").select("subscription_id", "ack_id", F.col("message.message_id").alias("message_id"), "attempt")


def dead_letter_messages(spark, sf):
    d = deadletter.routed(deadletter.dead_letters(journal(spark, sf), "view"), topic_stats(spark, sf))
    a = F.col("message.attributes")
    return d.select("topic_id", F.col("message.message_id").alias("message_id"), F.col("message.publish_time").alias("publish_time"), F.col("message.expire_time").alias("expire_time"), F.col("message.idempotency_key").alias("idempotency_key"), a[deadletter.SUBSCRIPTION_HEADER].alias("h_subscription"), a[deadletter.ATTEMPTS_HEADER].alias("h_attempts"), a[deadletter.ORIGINAL_HEADER].alias("h_original"), a["user"].alias("user"), "outcome")


def dead_letter_republish(spark, sf):
    """The letters that are left to publish when those of even events have been."""
    letters = deadletter.dead_letters(journal(spark, sf), "view")
    number = F.regexp_extract("message.message_id", r"(\d+)$", 1).cast("long")
    sent = letters.where(number % 2 == 0).select("message.message_id")
    return deadletter.unsent(letters, sent).select("topic_id", F.col("message.message_id").alias("message_id"), "source_subscription", "attempt")


def ttl_sweep(spark, sf):
    j = journal(spark, sf)
    return subscriptions.expire_messages(readmodels.past(readmodels.expiring(j), NOW), subscriptions.outstanding(j), NOW)


def attempts_per_message(spark, sf):
    return subscriptions.slim(journal(spark, sf)).where(F.col("attempts") > 0).select("subscription_id", "ack_id", "attempts")


def redelivery_counts(spark, sf):
    return readmodels.subscription_counters(journal(spark, sf)).select("subscription_id", "redelivered_total", "dead_lettered_total")


def record_delivery_replay(spark, sf):
    """The whole fan-out once more: what isn't outstanding any longer is delivered again."""
    j = journal(spark, sf)
    fresh, _ = subscriptions.record_delivery(delivery.fan_out(j), delivery.subscription_index(j).select("subscription_id"), subscriptions.slim(j))
    return fresh.select("subscription_id", "ack_id")


def existing_subscriptions(spark, sf):
    asked = synthetic.events(spark, sf).select(F.format_string("s-%s-%d", "event_type", F.col("event_id") % 5).alias("subscription_id")).distinct()
    return subscriptions.exists(asked, journal(spark, sf))


def subscription_sets(spark, sf):
    return delivery.sets_per_topic(subscription_index(spark, sf)).select("topic_id", F.concat_ws(",", "subscription_ids").alias("subscription_ids"))


def topic_lookup(spark, sf):
    return delivery.subscriptions_of(subscription_index(spark, sf), "click")


# Topics


def _topic_commands(spark, sf):
    """Orders as commands on a hundred topics: every tenth creates, updates or deletes, the others publish."""
    o = _parquet(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 40 == 1, "Create").when(F.col("o_orderkey") % 100 == 7, "Update").when(F.col("o_orderkey") % 900 == 9, "Delete").otherwise("Publish")
    message = F.when(kind == "Publish", F.struct(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("message_id"), F.col("o_orderpriority").cast("binary").alias("payload"), F.create_map().cast("map<string,string>").alias("attributes"), F.col("o_orderdate").alias("publish_time"), F.lit(None).cast("timestamp_ntz").alias("expire_time"), F.lit(None).cast("string").alias("idempotency_key")))
    return o.select(F.col("o_orderkey").alias("ordering"), F.concat(F.lit("t-"), (F.col("o_custkey") % 100).cast("string")).alias("topic_id"), kind.alias("kind"), F.create_map(F.lit("rev"), F.col("o_orderkey").cast("string")).alias("labels"), message.alias("message"))


def topic_create_first_wins(spark, sf):
    return topics.decide(_topic_commands(spark, sf)).where(F.col("kind") == "Create").select("topic_id", "ordering", "rejection")


def publish_rejections(spark, sf):
    return topics.decide(_topic_commands(spark, sf)).where((F.col("kind") == "Publish") & F.col("rejection").isNotNull()).select("topic_id", "ordering", "rejection")


def topic_delete_update(spark, sf):
    return topics.decide(_topic_commands(spark, sf)).where(F.col("kind").isin("Delete", "Update")).select("topic_id", "ordering", "kind", "rejection")


def topic_state(spark, sf):
    return topics.state(topics.decide(_topic_commands(spark, sf))).select("topic_id", F.col("labels")["rev"].alias("rev"), "deleted")


def topic_snapshot(spark, sf):
    return topics.snapshot(topics.state(topics.decide(_topic_commands(spark, sf)))).select("topic_id", F.col("labels")["rev"].alias("rev"))


def topic_events(spark, sf):
    return topics.events_of(topics.decide(_topic_commands(spark, sf))).groupBy("persistence_id", "type").agg(F.count(F.lit(1)).alias("n"))


def subscription_create(spark, sf):
    c = _parquet(spark, sf, "orders").select((F.col("o_orderkey")).alias("ordering"), F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("subscription_id"))
    return subscriptions.create(c)


def _publishes(spark, sf):
    return synthetic.messages(synthetic.events(spark, sf)).select("topic_id", "message.message_id", "message.publish_time", F.col("message.idempotency_key").alias("key"))


def dedup_publish(spark, sf):
    return topics.deduplicated(_publishes(spark, sf), DEDUP_DAYS * DAY_MS).select("topic_id", "message_id", "original_id", "deduplicated")


def dedup_stats(spark, sf):
    return dedup_publish(spark, sf).groupBy("topic_id").agg(F.count_if("deduplicated").alias("duplicates"), F.count_if(~F.col("deduplicated")).alias("accepted"))


# Consumers, tenants, credentials, text


def _calls(spark, sf):
    return synthetic.events(spark, sf).select(F.col("event_type").alias("subscription_id"), F.col("user_id").cast("string").alias("consumer_id"), F.col("ts").alias("at"))


def consumer_last_seen(spark, sf):
    return consumers.last_seen(_calls(spark, sf))


def active_consumers(spark, sf):
    return consumers.active(_calls(spark, sf), "2024-01-30 12:00:00", window_ms=5 * DAY_MS)


def _owners(spark, sf):
    c, n = _parquet(spark, sf, "customer"), _parquet(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("tenant"), F.col("c_name").alias("external"))


def tenant_qualify(spark, sf):
    o = _owners(spark, sf).withColumn("internal", ids.qualify(F.col("tenant"), F.col("external")))
    return o.select("c_custkey", "internal", ids.unqualify(F.col("tenant"), F.col("internal")).alias("external"), ids.valid_external(F.col("tenant"), F.col("internal")).alias("external_ok"), ids.belongs(F.lit("NATION_3"), F.col("internal")).alias("is_own"))


def tenant_listing(spark, sf):
    o = _owners(spark, sf).select("c_custkey", ids.qualify(F.col("tenant"), F.col("external")).alias("internal"))
    return tenancy.owned(o, "NATION_7", ["internal"]).select("c_custkey", "internal")


def _keys() -> list[AuthKey]:
    digest = lambda salt, token: base64.b64encode(hashlib.sha256(salt + token.encode()).digest()).decode()
    made = [(f"tenant{i}", f"salt{i}".encode(), f"token-{i % 4}") for i in range(6)]
    return [AuthKey(t, base64.b64encode(s).decode(), digest(s, token), frozenset({"admin"} if i % 2 else set())) for i, (t, s, token) in enumerate(made)]


def auth_match(spark, sf):
    s = _parquet(spark, sf, "supplier")
    header = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Bearer token-"), (F.col("s_suppkey") % 7).cast("string")))
    key = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("token-"), (F.col("s_suppkey") % 5).cast("string")))
    t = s.select("s_suppkey", auth.token(header, key).alias("token"))
    return auth.principals(t, _keys()).select("s_suppkey", "tenant", "key_position", auth.allowed(F.col("scopes"), "admin").alias("admin"))


def prometheus_lines(spark, sf):
    return metrics.page(subscription_listing_age(spark, sf), topic_listing(spark, sf), active_consumers(spark, sf)).select("block", "position", "line")


def label_escape(spark, sf):
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit('a"b\\c')).otherwise(F.lit("x\ny")))
    return _parquet(spark, sf, "part").select("p_partkey", exposition.escaped(text).alias("escaped"))


def ttl_expire_at(spark, sf):
    e = synthetic.events(spark, sf)
    ttl = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5_000)
    return e.select("event_id", messages.expire_at(F.col("ts"), ttl, 90_500).alias("expire_time"))


def event_codec_roundtrip(spark, sf):
    j = codec.from_json(codec.to_json(journal(spark, sf)).select("ordering", "persistence_id", F.col("json")))
    return j.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.count("message.message_id").alias("messages"), F.sum(F.octet_length("message.payload")).alias("payload_bytes"), F.max("message.publish_time").alias("last_publish"), F.count("message.expire_time").alias("expiries"), F.max("deadline").alias("last_deadline"), F.count(F.coalesce("ack_id", F.get("ack_ids", 0))).alias("acks"), F.sum("attempt").alias("attempts"))


def tag_routing(spark, sf):
    t = journal(spark, sf).select("type", F.explode_outer(ids.tags(F.col("type"))).alias("tag"))
    return t.groupBy("tag", "type").agg(F.count(F.lit(1)).alias("events"))


def persistence_id_parse(spark, sf):
    c = _parquet(spark, sf, "customer")
    pid = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Topic|").otherwise("Subscription|"), "c_name", F.when(F.col("c_custkey") % 5 == 0, "|x").otherwise(""))
    return c.select("c_custkey", ids.parsed("Topic", pid).alias("topic_id"), ids.parsed("Subscription", pid).alias("subscription_id"))


def snapshot_tail_equivalence(spark, sf):
    """State from a snapshot taken in the middle, and the tail after it."""
    j = journal(spark, sf)
    middle = j.agg((F.max("ordering") / 2).cast("long").alias("m")).collect()[0]["m"]
    return _flat(retention.recovered(j, middle))


def retention_cutoff(spark, sf):
    return retention.cutoffs(journal(spark, sf), every=100, keep=2)


def purged_journal(spark, sf):
    j = journal(spark, sf)
    left = retention.purged(retention.numbered(j.select("persistence_id", "ordering", "type")), retention.cutoffs(j))
    return left.groupBy("persistence_id").agg(F.count(F.lit(1)).alias("events"), F.min("seq_nr").alias("first_seq"))


def journal_counts(spark, sf):
    return journal(spark, sf).groupBy("persistence_id").agg(F.count(F.lit(1)).alias("events"))


def supplier_backlog(spark, sf):
    """The statistics join at scale: open lines of every supplier, the oldest of them, and returned lines."""
    line, s = _parquet(spark, sf, "lineitem"), _parquet(spark, sf, "supplier")
    b = line.where(F.col("l_linestatus") == "O").select(F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("subscription_id"), F.col("l_orderkey").alias("ack_id"), F.col("l_shipdate").alias("delivered_at"))
    dead = line.where(F.col("l_returnflag") == "R").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("dead_lettered_total"))
    c = s.join(dead, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("subscription_id"), F.col("s_nationkey").cast("string").alias("topic_id"), F.lit(0).cast("long").alias("redelivered_total"), F.coalesce("dead_lettered_total", F.lit(0)).alias("dead_lettered_total"))
    return readmodels.subscription_stats(c, b)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}


def queries() -> dict:
    return dict(QUERIES)
