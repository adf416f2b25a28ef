"""Scenarios of the broker's rules on literal journals, and closed forms against sequential folds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.broker import Broker, status
from tidemark.client import BrokerError, Client
from tidemark.config import AuthKey, BrokerConfig
from tidemark.functions import auth, codec, exposition, ids, messages
from tidemark.operators import consumers, deadletter, dedup, delivery, metrics, readmodels, retention, subscriptions, tenancy, topics
from tidemark.schemas import JOURNAL, MESSAGE, READ_MODELS, SUBSCRIPTION_EVENTS, TERMINAL, TOPIC_COMMANDS, create_tables
from tidemark.sources import journal as store

T0 = datetime(2026, 7, 7, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def message(i, seconds=0, expire=None, key=None, attributes=None):
    return (f"m-{i}", b"hi", attributes or {}, at(seconds), None if expire is None else at(expire), key)


class Log:
    """A journal being written down."""

    def __init__(self):
        self.rows = []

    def add(self, kind, sub=None, topic=None, ack=None, acks=None, msg=None, deadline=None, attempt=None, labels=None, pid=None):
        pid = pid or (f"Topic|{topic}" if kind.startswith("Topic") or kind == "MessagePublished" else f"Subscription|{sub}")
        self.rows.append((len(self.rows), pid, kind, topic if kind != "MessagePublished" else None, sub if kind == "SubscriptionCreated" else None, labels, msg, ack, acks, None if deadline is None else at(deadline), attempt))
        return self

    def df(self, spark):
        return spark.createDataFrame(self.rows, JOURNAL)


def started(sub="s1", topic="orders"):
    return Log().add("SubscriptionCreated", sub=sub, topic=topic)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_backlog_after_three_deliveries_and_an_ack(spark):
    log = started()
    for i in range(3):
        log.add("MessageDelivered", sub="s1", ack=f"a{i}", msg=message(i, i))
    j = log.add("MessageAcknowledged", sub="s1", ack="a0").df(spark)
    stats = readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))
    assert rows(stats, "subscription_id", "backlog", "redelivered_total", "oldest") == [("s1", 2, 0, at(1))]


def test_age_of_the_oldest(spark):
    j = started().add("MessageDelivered", sub="s1", ack="a", msg=message(1)).df(spark)
    stats = readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))
    listing = readmodels.subscription_listing(stats, str(at(90)))
    assert listing.first()["oldest_age_seconds"] == 90
    assert readmodels.subscription_listing(stats, str(at(-90))).first()["oldest_age_seconds"] == 0
    none = readmodels.subscription_listing(readmodels.subscription_stats(readmodels.subscription_counters(started().df(spark)), readmodels.backlog(started().df(spark))), str(at(90)))
    assert rows(none, "backlog", "oldest_age_seconds") == [(0, 0)]


def test_redelivered_and_dead_lettered(spark):
    j = started().add("MessageDelivered", sub="s1", ack="a", msg=message(1)).add("AckDeadlineExpired", sub="s1", ack="a", attempt=1).add("MessageDeadLettered", sub="s1", ack="a", msg=message(1), attempt=2).df(spark)
    stats = readmodels.subscription_stats(readmodels.subscription_counters(j), readmodels.backlog(j))
    assert rows(stats, "redelivered_total", "dead_lettered_total", "backlog") == [(1, 1, 0)]


def test_published_and_deleted_topics(spark):
    log = Log().add("TopicCreated", topic="orders", labels={}).add("TopicCreated", topic="old", labels={})
    for i in range(3):
        log.add("MessagePublished", topic="orders", msg=message(i))
    j = log.add("TopicDeleted", topic="old").add("MessagePublished", topic="a|b", msg=message(9)).df(spark)
    assert rows(readmodels.topic_stats(j), "topic_id", "published_total", "deleted") == [("old", 0, True), ("orders", 3, False)]


def test_lease_index_follows_the_last_event(spark):
    log = started()
    for a in "abcde":
        log.add("MessageDelivered", sub="s1", ack=a, msg=message(a))
    log.add("MessageLeased", sub="s1", acks=list("abcd"), deadline=30).add("AckDeadlineModified", sub="s1", ack="a", deadline=60)
    j = log.add("AckDeadlineExpired", sub="s1", ack="b", attempt=1).add("MessageAcknowledged", sub="s1", ack="c").df(spark)
    leases = readmodels.leases(j)
    assert rows(leases, "ack_id", "deadline") == [("a", at(60)), ("d", at(30))]
    assert rows(readmodels.overdue(leases, str(at(30))), "ack_id") == [("d",)]
    assert readmodels.overdue(leases, str(at(29))).count() == 0


def test_pull_skips_leased_and_expired(spark):
    log = started()
    for i in range(6):
        log.add("MessageDelivered", sub="s1", ack=f"a{i}", msg=message(i, expire=10 if i == 1 else None))
    state = subscriptions.outstanding(log.add("MessageLeased", sub="s1", acks=["a0"], deadline=30).df(spark))
    assert [r["ack_id"] for r in subscriptions.pull(state, 2, str(at(10))).orderBy("position").collect()] == ["a2", "a3"]
    assert [r["ack_id"] for r in subscriptions.pull(state, 2, str(at(9))).orderBy("position").collect()] == ["a1", "a2"]
    assert subscriptions.pull(state, -1, str(at(0))).count() == 0 and subscriptions.lease(state, 0, str(at(0))).count() == 0
    lease = subscriptions.lease(state, 3, str(at(10)), 30_000).first()
    assert (lease["ack_ids"], lease["deadline"]) == (["a2", "a3", "a4"], at(40))


@pytest.mark.parametrize(("attempts", "limit", "event"), [(1, 3, "AckDeadlineExpired"), (2, 3, "MessageDeadLettered"), (9, 0, "AckDeadlineExpired")])
def test_expiry_or_dead_letter(spark, attempts, limit, event):
    log = started().add("MessageDelivered", sub="s1", ack="a", msg=message(1)).add("AckDeadlineExpired", sub="s1", ack="a", attempt=attempts).add("MessageLeased", sub="s1", acks=["a"], deadline=30)
    j = log.df(spark)
    state, due = subscriptions.outstanding(j), readmodels.leases(j)
    assert rows(subscriptions.expire_deadlines(due, state, str(at(30)), limit), "event", "attempt") == [(event, attempts + 1)]
    assert subscriptions.expire_deadlines(due, state, str(at(29)), limit).count() == 0
    stale = subscriptions.outstanding(log.add("MessageAcknowledged", sub="s1", ack="a").df(spark))
    assert subscriptions.expire_deadlines(due, stale, str(at(30)), limit).count() == 0


def test_acks_and_deadlines(spark):
    state = subscriptions.outstanding(started().add("MessageDelivered", sub="s1", ack="a", msg=message(1)).add("MessageDelivered", sub="s1", ack="b", msg=message(2)).df(spark))
    req = spark.createDataFrame([("s1", "b", 0, 10_000), ("s1", "x", 1, 1), ("s1", "a", 2, 0), ("s1", "b", 3, 5), ("s1", " ", 4, 5)], "subscription_id string, ack_id string, position long, deadline_ms long")
    reply = subscriptions.batch_reply(subscriptions.split_acks(req, state)).first()
    assert (reply["applied"], reply["unknown"]) == (["b", "a"], ["x", "b", " "])
    m = subscriptions.modify_deadline(req, state, str(at(0)))
    assert [tuple(r) for r in m.orderBy("position").select("event", "attempt", "deadline", "rejection").collect()] == [("AckDeadlineModified", None, at(10), None), (None, None, None, "UnknownAckId"), ("AckDeadlineExpired", 0, None, None), (None, None, None, "UnknownAckId"), (None, None, None, "UnknownAckId")]


def fold(log):
    """The sequential fold of subscriptions, as the broker's entities do it."""
    state = {}
    for o, pid, kind, _, _, _, msg, ack, acks, deadline, attempt in log:
        sub = pid.split("|")[1]
        if kind == "MessageDelivered":
            state[sub, ack] = [o, msg[0], "Available", None, 0]
        elif kind == "MessageLeased":
            for a in acks:
                if (sub, a) in state:
                    state[sub, a][2:4] = ["Leased", deadline]
        elif kind == "AckDeadlineModified" and (sub, ack) in state:
            state[sub, ack][2:4] = ["Leased", deadline]
        elif kind == "AckDeadlineExpired" and (sub, ack) in state:
            state[sub, ack][2:] = ["Available", None, attempt]
        elif kind in TERMINAL:
            state.pop((sub, ack), None)
    return sorted((s, a, *v) for (s, a), v in state.items())


def random_log(seed, n=1500):
    rng, log = random.Random(seed), Log()
    for i in range(n):
        sub, ack = f"s{rng.randrange(3)}", f"a{rng.randrange(25)}"
        kind = rng.choice(SUBSCRIPTION_EVENTS[1:])
        log.add(kind, sub=sub, ack=None if kind == "MessageLeased" else ack, acks=[ack, f"a{rng.randrange(25)}"] if kind == "MessageLeased" else None, msg=message(i, i) if kind in ("MessageDelivered", "MessageDeadLettered") else None, deadline=i + 30 if kind in ("MessageLeased", "AckDeadlineModified") else None, attempt=rng.randrange(6) if kind == "AckDeadlineExpired" else None)
    return log


@pytest.mark.parametrize("seed", range(3))
def test_closed_form_is_the_fold_and_survives_snapshots(spark, seed):
    log = random_log(seed)
    j = log.df(spark)
    want = fold(log.rows)
    sort = lambda xs: sorted(xs, key=lambda x: x[:2])
    assert sort(flat_rows(subscriptions.outstanding(j))) == want
    assert sort(flat_rows(retention.recovered(j, 700))) == want


def flat_rows(s):
    return [(r["subscription_id"], r["ack_id"], r["delivered"], r["message"]["message_id"], r["lease_state"], r["deadline"], r["attempts"]) for r in s.collect()]


def test_retention_keeps_two_snapshots(spark):
    j = spark.createDataFrame([(i, "Subscription|s", "MessageAcknowledged") for i in range(250)], "ordering long, persistence_id string, type string")
    c = retention.cutoffs(j, every=100, keep=2)
    assert rows(c, "events", "last_snapshot", "cutoff") == [(250, 200, 100)]
    assert retention.purged(retention.numbered(j), c).count() == 150


def test_numbers_of_a_hot_id_over_many_partitions(spark):
    rows_ = [(i * 3, "Topic|hot" if i % 4 else f"Topic|{i % 40}", "MessagePublished") for i in range(2000)]
    got = retention.numbered(spark.createDataFrame(rows_, "ordering long, persistence_id string, type string").repartition(5), parts=13).collect()
    want, seen = set(), {}
    for o, pid, kind in rows_:
        seen[pid] = seen.get(pid, 0) + 1
        want.add((o, pid, kind, seen[pid]))
    assert {tuple(r) for r in got} == want and len(got) == 2000


def test_delivery_only_to_earlier_subscriptions(spark):
    log = Log().add("TopicCreated", topic="t", labels={}).add("MessagePublished", topic="t", msg=message(0)).add("SubscriptionCreated", sub="s1", topic="t").add("MessagePublished", topic="t", msg=message(1)).add("SubscriptionCreated", sub="s2", topic="t").add("SubscriptionCreated", sub="x", topic="other")
    j = log.add("MessagePublished", topic="t", msg=message(2)).df(spark)
    fan = delivery.fan_out(j)
    assert rows(fan, "ack_id") == [("s1:m-1",), ("s1:m-2",), ("s2:m-2",)]
    state = subscriptions.outstanding(log.add("MessageDelivered", sub="s1", ack="s1:m-1", msg=message(1)).df(spark))
    ghost = fan.limit(1).withColumn("subscription_id", F.lit("ghost"))
    fresh, lost = subscriptions.record_delivery(fan.unionByName(fan).unionByName(ghost), delivery.subscription_index(j).select("subscription_id"), state)
    assert rows(fresh, "ack_id") == [("s1:m-2",), ("s2:m-2",)]
    assert rows(lost, "subscription_id", "rejection") == [("ghost", "SubscriptionNotFound")]


def commands(spark, *items):
    return spark.createDataFrame([(i, t, k, lab, None) for i, (t, k, lab) in enumerate(items)], TOPIC_COMMANDS)


def test_topic_lifecycle(spark):
    c = commands(spark, ("t", "Publish", None), ("t", "Create", {"a": "1"}), ("t", "Create", {}), ("t", "Update", {"b": "2"}), ("t", "Publish", None), ("t", "Delete", None), ("t", "Publish", None), ("t", "Delete", None), ("t", "Update", {}), ("t", "Create", {}), ("u", "Create", {"x": "y"}))
    d = topics.decide(c)
    assert [r["rejection"] for r in d.orderBy("ordering").collect()] == ["TopicNotFound", None, "TopicAlreadyExists", None, None, None, "TopicNotFound", "TopicNotFound", "TopicNotFound", "TopicAlreadyExists", None]
    s = topics.state(d)
    assert sorted((r["topic_id"], r["labels"], r["deleted"]) for r in s.collect()) == [("t", {"b": "2"}, True), ("u", {"x": "y"}, False)]
    assert rows(topics.snapshot(s), "topic_id") == [("u",)]


@pytest.mark.parametrize(("seed", "keys", "parts", "steps"), [(0, 2, 4, 256), (1, 2, 1, 256), (2, 1, 7, 256), (3, 1, 7, 0), (4, 30, 5, 0), (5, 1, 40, 0), (6, 1, 40, 256), (7, 3, 90, 1)])
def test_dedup_is_the_anchored_fold(spark, monkeypatch, seed, keys, parts, steps):
    """One hot key over many partitions, windows longer and shorter than a partition, functions that are looked up."""
    monkeypatch.setattr(dedup, "STEPS", steps)
    rng = random.Random(seed)
    pubs = [("t", f"m-{i:03}", at(rng.randrange(2000)), rng.choice([*(f"k{n}" for n in range(keys)) , *(["", None] if keys > 1 else [])])) for i in range(300)]
    seen, want = {}, {}
    for t, m, when, k in sorted(pubs, key=lambda p: (p[2], p[1])):
        first = seen.get(k)
        if k and first and first[0] >= when - timedelta(seconds=60):
            want[m] = first[1]
        else:
            want[m] = m
            if k:
                seen[k] = (when, m)
    got = topics.deduplicated(spark.createDataFrame(pubs, "topic_id string, message_id string, publish_time timestamp_ntz, key string"), 60_000, parts)
    assert {r["message_id"]: r["original_id"] for r in got.collect()} == want
    assert not topics.deduplicated(spark.createDataFrame(pubs, got.drop("original_id", "deduplicated").schema), 0).where("deduplicated").count()


def test_dead_letters_lose_expiry_and_key(spark):
    m = message(1, 5, expire=60, key="k", attributes={"a": "b", "x-delivery-attempts": "old"})
    log = started().add("MessageDeadLettered", sub="s1", ack="a", msg=m, attempt=5).add("MessageDeadLettered", sub="s1", ack="a", msg=m, attempt=5)
    d = deadletter.dead_letters(log.df(spark), "dlq").collect()
    assert len(d) == 1 and d[0]["message"]["message_id"] == "dead-letter:s1:m-1"
    assert d[0]["message"]["attributes"] == {"a": "b", "x-dead-letter-subscription": "s1", "x-delivery-attempts": "5", "x-original-message-id": "m-1"}
    assert (d[0]["message"]["publish_time"], d[0]["message"]["expire_time"], d[0]["message"]["idempotency_key"]) == (at(5), None, None)
    assert deadletter.dead_letters(log.df(spark), None).count() == 0
    out = deadletter.routed(deadletter.dead_letters(log.df(spark), "dlq"), spark.createDataFrame([("other",)], "topic_id string"))
    assert out.first()["outcome"] == "TopicNotFound"


def test_active_consumers(spark):
    calls = spark.createDataFrame([("s", "c1", at(0)), ("s", "c1", at(30)), ("s", "c2", at(-1)), ("u", "c1", at(-1)), ("s", "", at(50))], "subscription_id string, consumer_id string, at timestamp_ntz")
    assert rows(consumers.active(calls, str(at(60)), 60_000), "subscription_id", "active_consumers") == [("s", 1)]
    assert rows(consumers.active(calls, str(at(59)), 60_000), "subscription_id", "active_consumers") == [("s", 2), ("u", 1)]
    assert consumers.active(calls, str(at(0)), 0).count() == 0


def test_tenants(spark):
    d = spark.createDataFrame([("acme~a",), ("acmex~a",), ("plain",)], "id string")
    assert rows(tenancy.owned(d, "acme", ["id"]), "id") == [("a",)]
    assert rows(tenancy.owned(d, None, ["id"]), "id") == [("plain",)]
    x = spark.range(1).select(ids.qualify(F.lit("t"), F.lit("x")).alias("q"), ids.qualify(F.lit(None).cast("string"), F.lit("x")).alias("n"), ids.valid_external(F.lit("t"), F.lit("a~b")).alias("v"), ids.valid(F.lit(" \t\n")).alias("b"), ids.valid(F.lit(" ")).alias("nb"), ids.valid_tenant(F.lit("a~")).alias("vt")).first()
    assert tuple(x) == ("t~x", "x", False, False, True, False)


def test_credentials(spark):
    import base64
    import hashlib

    key = lambda t, s, token, scopes=(): AuthKey(t, base64.b64encode(s).decode(), base64.b64encode(hashlib.sha256(s + token).digest()).decode(), frozenset(scopes))
    keys = [key("a", b"1", b"one"), key("b", b"2", b"two", ["admin"]), key("c", b"3", b"one")]
    h = spark.createDataFrame([("Bearer one", "two"), (None, "two"), ("Basic x", None), ("bearer one", None)], "h string, k string")
    got = auth.principals(h.select(auth.token(F.col("h"), F.col("k")).alias("token")), keys).withColumn("admin", auth.allowed(F.col("scopes"), "admin")).collect()
    assert [(r["tenant"], r["admin"]) for r in got] == [("a", False), ("b", True), (None, False), (None, False)]


def test_codec_round_trip_and_older_forms(spark):
    log = random_log(7, 200).add("TopicCreated", topic="t", labels={"a": "b"}).add("MessagePublished", topic="t", msg=message(1, 0.123456, expire=5, key="k", attributes={"x": "y"}))
    j = log.df(spark)
    back = codec.from_json(codec.to_json(j).select("ordering", "persistence_id", "json"))
    key = lambda d: sorted(map(repr, d.select("ordering", "type", "topic_id", "labels", "message", "ack_id", "ack_ids", "deadline", "attempt").collect()))
    assert key(back) == key(j)
    old = spark.createDataFrame([('{"type":"TopicCreated","topicId":"orders"}',), ('{"type":"MessagePublished","message":{"id":"m","payload":"aGk=","attributes":{},"publishTime":"2026-07-07T00:00:00Z"}}',)], "json string")
    got = codec.from_json(old).collect()
    assert got[0]["labels"] == {} and bytes(got[1]["message"]["payload"]) == b"hi" and got[1]["message"]["expire_time"] is None
    with pytest.raises(Exception, match="unknown event"):
        codec.from_json(spark.createDataFrame([('{"type":"Strange"}',)], "json string")).collect()


def test_metrics_page(spark):
    subs = spark.createDataFrame([('s"1\\\n', "t", 2, 90, 1, 0)], "subscription_id string, topic_id string, backlog long, oldest_age_seconds long, redelivered_total long, dead_lettered_total long")
    tops = spark.createDataFrame([("t", 3, False)], "topic_id string, published_total long, deleted boolean")
    act = spark.createDataFrame([("b", 2), ("a", 1)], "subscription_id string, active_consumers long")
    page = exposition.exposition(metrics.page(subs, tops, act))
    assert 'broker_subscription_backlog{subscription="s\\"1\\\\\\n"} 2\n' in page and 'broker_messages_published_total{topic="t"} 3\n' in page
    assert page.index('consumers{subscription="a"} 1') < page.index('consumers{subscription="b"} 2') and page.count("# TYPE") == 6


def test_expiry_times(spark):
    e = spark.createDataFrame([(at(0), 1999), (at(0), None), (at(0), 0), (at(0), 500)], "t timestamp_ntz, ttl long")
    assert [r[0] for r in e.select(messages.expire_at(F.col("t"), F.col("ttl"))).collect()] == [at(1), None, None, at(0)]
    assert [r[0] for r in e.select(messages.expire_at(F.col("t"), F.col("ttl"), 2_500)).collect()] == [at(1), at(2), at(2), at(0)]


@pytest.mark.parametrize("bad", [{"http_port": 0}, {"http_port": 70_000}, {"ack_deadline_ms": 0}, {"max_delivery_attempts": -1}, {"auth_enabled": True}, {"default_tenant": "a~b"}, {"database": " "}, {"keep_snapshots": 0}, {"auth_keys": (AuthKey("t", "", "h"),)}])
def test_config_fails_fast(bad):
    with pytest.raises(ValueError):
        BrokerConfig(**bad)


def test_config_defaults():
    c = BrokerConfig.from_env(env={"TIDEMARK_DEAD_LETTER_TOPIC": " dlq ", "TIDEMARK_MAX_DELIVERY_ATTEMPTS": "0"})
    assert (c.dead_letter_topic, c.max_delivery_attempts, c.ack_deadline_ms, c.activity_window_ms) == ("dlq", 0, 30_000, 60_000)
    assert BrokerConfig(dead_letter_topic="  ").dead_letter_topic is None
    assert BrokerConfig.seeds_of(" a, ,b ", "me") == ("a", "b") and BrokerConfig.seeds_of("", "me") == ("me",)


def reqs(spark, schema, *items):
    return spark.createDataFrame([(*x, i) for i, x in enumerate(items)], f"{schema}, position long")


PUBLISH = "topic_id string, message_id string, payload binary, attributes map<string,string>, ttl_seconds long, idempotency_key string"


def test_broker_from_publish_to_dead_letter(spark, tmp_path):
    """No event is made by hand: publish, deliver, pull, lapse, redeliver, dead-letter, republish; acks, deadlines, TTL and snapshots on the way."""
    b = Broker(spark, str(tmp_path / "journal"), BrokerConfig(dedup_window_ms=60_000, dead_letter_topic="dlq", max_delivery_attempts=2, snapshot_every=5, default_ttl_ms=86_400_000))
    assert b.ready() == (200, "UP") == b.health()
    d = b.topic_command(reqs(spark, "topic_id string, kind string, labels map<string,string>", ("orders", "Create", {"a": "b"}), ("orders", "Create", {}), ("dlq", "Create", {}), ("none", "Update", {}), (" ", "Create", {}), ("old", "Create", {}), ("old", "Delete", None)))
    assert [(r["outcome"], r["status"]["rest"]) for r in d.orderBy("position").collect()] == [("Created", 201), ("TopicAlreadyExists", 409), ("Created", 201), ("TopicNotFound", 404), ("ValidationError", 400), ("Created", 201), ("Deleted", 204)]
    again = b.topic_command(reqs(spark, "topic_id string, kind string", ("orders", "Create"), ("orders", "Update"), ("old", "Create"))).orderBy("position").collect()
    assert [r["status"]["rpc"] for r in again] == ["ALREADY_EXISTS", "OK", "ALREADY_EXISTS"]
    assert rows(b.get_topic(), "topic_id", "labels") == [("dlq", {}), ("orders", {})]
    made = b.create_subscription(reqs(spark, "subscription_id string, topic_id string", ("s1", "orders"), ("s1", "orders"), ("s2", "nowhere"), (" ", "orders"), ("dead", "dlq")))
    assert [r["outcome"] for r in made.orderBy("position").collect()] == ["Created", "SubscriptionAlreadyExists", "Created", "ValidationError", "Created"]

    d = b.publish(reqs(spark, PUBLISH, ("orders", "m-1", b"one", {"x": "y"}, None, "k"), ("orders", "m-2", b"two", None, 30, "k"), ("none", "m-3", b"", None, None, None), ("orders", "m-4", b"four", None, 20, ""), ("old", "m-5", b"", None, None, None)), str(at(0)))
    assert [(r["outcome"], r["status"]["rest"], r["message_id"], r["deduplicated"], r["expire_time"]) for r in d.orderBy("position").collect()] == [("Published", 202, "m-1", False, at(86_400)), ("Published", 202, "m-1", True, at(30)), ("TopicNotFound", 404, None, None, None), ("Published", 202, "m-4", False, at(20)), ("TopicNotFound", 404, None, None, None)]
    later = b.publish(reqs(spark, PUBLISH, ("orders", "m-6", b"six", None, None, "k")), str(at(60))).first()
    assert (later["message_id"], later["deduplicated"]) == ("m-1", True)  # the window's end is within it
    assert b.publish(reqs(spark, PUBLISH, ("orders", "m-7", b"seven", None, None, "k")), str(at(61))).first()["deduplicated"] is False
    assert (b.deliver(), b.deliver()) == (3, 0)

    p = b.pull(reqs(spark, "subscription_id string, max int, consumer_id string", ("s1", 1, "c1"), ("s1", None, "c2"), ("zz", 1, "c3"), ("s1", 0, None), ("s2", 5, " ")), str(at(10)))
    assert [(r["outcome"], r["status"]["rest"], [m["ack_id"] for m in r["messages"]]) for r in p.orderBy("position").collect()] == [("Accepted", 200, ["s1:m-1"]), ("Accepted", 200, ["s1:m-4", "s1:m-7"]), ("SubscriptionNotFound", 404, []), ("Accepted", 200, []), ("Accepted", 200, [])]
    m = p.orderBy("position").first()["messages"][0]
    assert (m["payload"], m["attributes"], m["publish_time"]) == ("one", {"x": "y"}, "2026-07-07T12:00:00Z")
    assert b.pull(reqs(spark, "subscription_id string", ("s1",)), str(at(11))).first()["messages"] == []
    assert rows(b.calls(), "subscription_id", "consumer_id") == [("s1", "c1"), ("s1", "c2"), ("zz", "c3")]
    assert (b.sweep(str(at(39))), b.sweep_ttl(str(at(19)))) == (0, 0)
    assert b.sweep_ttl(str(at(20))) == 1  # m-4, though it is leased

    head = b.snapshot()
    assert head == store.head(spark, b.path) and b.snapshot() is None
    assert rows(b.state(), "ack_id", "lease_state", "attempts") == [("s1:m-1", "Leased", 0), ("s1:m-7", "Leased", 0)]
    assert b.sweep(str(at(40))) == 2 and rows(b.state(), "ack_id", "lease_state", "attempts") == [("s1:m-1", "Available", 1), ("s1:m-7", "Available", 1)]
    b.pull(reqs(spark, "subscription_id string", ("s1",)), str(at(50)))
    ask = "subscription_id string, ack_id string, deadline_ms long"
    m = b.modify_deadline(reqs(spark, ask, ("s1", "s1:m-7", 60_000), ("s1", "gone", 1), ("zz", "q", 1)), str(at(55)))
    assert rows(m, "subscription_id", "modified", "unknown", "outcome") == [("s1", ["s1:m-7"], ["gone"], "Accepted"), ("zz", [], ["q"], "SubscriptionNotFound")]
    assert b.sweep(str(at(80))) == 1  # m-1 for the second time
    assert b.snapshot() is not None
    letters = b.republish_dead_letters()
    assert rows(letters, "message_id", "source_subscription", "attempt", "outcome") == [("dead-letter:s1:m-1", "s1", 2, "Published")]
    assert b.republish_dead_letters().count() == 0 and b.deliver() == 1
    got = b.pull(reqs(spark, "subscription_id string", ("dead",)), str(at(90))).first()["messages"]
    assert [x["ack_id"] for x in got] == ["dead:dead-letter:s1:m-1"] and got[0]["attributes"]["x-original-message-id"] == "m-1"

    req = reqs(spark, "subscription_id string, ack_id string", ("s1", "s1:m-7"), ("s1", "s1:m-7"), ("s1", " "), ("zz", "q"))
    assert rows(b.acknowledge(req, rpc=True), "subscription_id", "applied", "unknown", "outcome") == [("s1", ["s1:m-7"], ["s1:m-7", " "], "Accepted"), ("zz", [], ["q"], "SubscriptionNotFound")]
    assert rows(b.acknowledge(req), "subscription_id", "applied", "outcome") == [("s1", [], "Accepted"), ("zz", [], "Accepted")]
    assert rows(b.list_subscriptions(str(at(100))), "subscription_id", "backlog", "redelivered_total", "dead_lettered_total") == [("dead", 1, 0, 0), ("s1", 0, 2, 1), ("s2", 0, 0, 0)]
    assert rows(b.list_topics(), "topic_id", "published_total", "deleted") == [("dlq", 1, False), ("old", 0, True), ("orders", 3, False)]
    b.snapshot()
    assert len(store.snapshots(spark, f"{b.path}/_snapshots")) == 2
    kept = store.snapshots(spark, f"{b.path}/_snapshots")
    assert b.journal().where(F.col("type").isin("MessageLeased", "AckDeadlineModified") & (F.col("ordering") <= kept[0])).count() == 0
    assert rows(b.state(), "ack_id", "lease_state", "attempts") == [("dead:dead-letter:s1:m-1", "Leased", 0)]
    page = exposition.exposition(b.metrics(str(at(62))))
    assert 'broker_subscription_consumers{subscription="s1"} 2' in page and 'broker_messages_dead_lettered_total{subscription="s1"} 1' in page
    assert spark.range(1).select(status(F.lit("?"))["rest"]).first()[0] == 500


def test_pulls_of_a_batch_are_disjoint(spark):
    state = spark.createDataFrame([("s" if i % 3 else f"t{i % 2}", f"a{i:03}", i, message(i, i), "Available", None, 0) for i in range(200)], "subscription_id string, ack_id string, delivered long, message " + MESSAGE + ", lease_state string, deadline timestamp_ntz, attempts int")
    asked = spark.createDataFrame([("s", i, i % 7 - 1) for i in range(40)] + [("t0", 50, 1000), ("none", 51, 3)], "subscription_id string, position long, max int")
    got = subscriptions.assigned(state, asked, str(at(0))).collect()
    left, want = {s: [f"a{i:03}" for i in range(200) if (s == "s") == bool(i % 3) and (s == "s" or f"t{i % 2}" == s)] for s in ("s", "t0")}, {}
    for s, pos, n in [("s", i, i % 7 - 1) for i in range(40)] + [("t0", 50, 1000)]:
        for a in left[s][: max(0, n)]:
            want[a] = pos
        left[s] = left[s][max(0, n) :]
    assert {r["ack_id"]: r["position"] for r in got} == want and len(got) == len(want)


def test_tenants_and_scopes_in_the_verbs(spark, tmp_path):
    import base64
    import hashlib

    key = lambda t, token, *scopes: AuthKey(t, base64.b64encode(b"s").decode(), base64.b64encode(hashlib.sha256(b"s" + token.encode()).digest()).decode(), frozenset(scopes))
    b = Broker(spark, str(tmp_path / "journal"), BrokerConfig(auth_enabled=True, auth_keys=(key("acme", "one", "admin"), key("acme", "two"), key("other", "three", "admin"))))
    who = "authorization string, api_key string"
    d = b.topic_command(reqs(spark, f"topic_id string, kind string, {who}", ("t", "Create", "Bearer one", None), ("t", "Create", None, "three"), ("u", "Create", "Bearer two", None), ("u", "Create", None, None), ("a~b", "Create", "Bearer one", None)))
    assert [(r["topic_id"], r["outcome"], r["status"]["rest"]) for r in d.orderBy("position").collect()] == [("t", "Created", 201), ("t", "Created", 201), ("u", "Forbidden", 403), ("u", "Unauthenticated", 401), ("a~b", "ValidationError", 400)]
    assert rows(b.get_topic("acme"), "topic_id") == [("t",)] and rows(b.get_topic(), "topic_id") == []
    b.create_subscription(reqs(spark, f"subscription_id string, topic_id string, {who}", ("s", "t", "Bearer two", None), ("s", "t", "Bearer three", None)))
    b.publish(reqs(spark, PUBLISH + ", " + who, ("t", "m-1", b"x", None, None, None, "Bearer two", None), ("t", "m-2", b"x", None, None, None, "Bearer nobody", None)), str(at(0)))
    assert b.deliver() == 1
    p = b.pull(reqs(spark, f"subscription_id string, max int, consumer_id string, {who}", ("s", 5, "c", "Bearer three", None), ("s", 5, "c", "Bearer two", None), ("s", 5, "c", None, None)), str(at(1))).orderBy("position").collect()
    assert [(r["subscription_id"], r["outcome"], len(r["messages"])) for r in p] == [("s", "Accepted", 0), ("s", "Accepted", 1), ("s", "Unauthenticated", 0)]
    ack = p[1]["messages"][0]["ack_id"]
    got = b.acknowledge(reqs(spark, f"subscription_id string, ack_id string, {who}", ("s", ack, "Bearer three", None), ("s", ack, None, "two")), rpc=True)
    assert sorted((r["applied"], r["unknown"]) for r in got.collect()) == [([], [ack]), ([ack], [])]
    assert rows(b.list_subscriptions(str(at(2)), "acme"), "subscription_id", "topic_id", "backlog") == [("s", "t", 0)]
    assert rows(b.list_topics("other"), "topic_id", "published_total") == [("t", 0)] and b.list_topics().count() == 0


def test_client(spark, tmp_path):
    c = Client(Broker(spark, str(tmp_path / "journal")), clock=lambda: str(at(0)))
    c.create_topic("t", {"a": "b"})
    c.update_topic("t", {"c": "d"})
    assert c.get_topic("t") == {"c": "d"}
    with pytest.raises(BrokerError, match="TopicAlreadyExists"):
        c.create_topic("t")
    c.create_subscription("s", "t")
    sent = c.publish("t", "hello", {"k": "v"})
    c.broker.deliver()
    (m,) = c.pull("s")
    assert (m["message_id"], m["payload"], m["attributes"]) == (sent, "hello", {"k": "v"})
    assert c.ack("s", [m["ack_id"], "x"]) == [m["ack_id"]] and c.ack("s", []) == []
    c.delete_topic("t")
    for call in (lambda: c.get_topic("t"), lambda: c.publish("t", b"x"), lambda: c.pull("none")):
        with pytest.raises(BrokerError) as e:
            call()
        assert (e.value.rest, e.value.rpc) == (404, "NOT_FOUND")


def test_tables_are_made_once_and_readiness_fails_without_a_journal(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS views LOCATION '{tmp_path}/views'")
    for _ in range(2):
        Broker(spark, str(tmp_path / "j"), BrokerConfig(database="views"))
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN views").collect()} == set(READ_MODELS)
    with pytest.raises(Exception):
        create_tables(spark, "no such database", max_wait_ms=20, step_ms=10)
    (tmp_path / "broken" / "commit=0").mkdir(parents=True)
    (tmp_path / "broken" / "commit=0" / "x.parquet").write_text("no table")
    assert Broker(spark, str(tmp_path / "broken")).ready() == (503, "DOWN")


def test_requests_from_files(spark, tmp_path):
    commands(spark, ("t", "Create", {"a": "1"}), (" ", "Create", {})).write.json(str(tmp_path / "topics"))
    got = store.validated(store.topic_commands(spark, str(tmp_path / "topics")), ["topic_id"])
    assert rows(got, "topic_id", "kind", "labels") == [("t", "Create", {"a": "1"})]
    spark.createDataFrame([(1, "s", "Pull", 5)], "ordering long, subscription_id string, kind string, max int").write.parquet(str(tmp_path / "subs"))
    assert rows(store.subscription_commands(spark, str(tmp_path / "subs"), "parquet"), "subscription_id", "kind", "max") == [("s", "Pull", 5)]
    assert rows(delivery.sets_per_topic(delivery.subscription_index(started().add("SubscriptionCreated", sub="s0", topic="orders").df(spark))), "topic_id", "subscription_ids") == [("orders", ["s0", "s1"])]
    assert spark.createDataFrame([(at(0), at(60))], "a timestamp_ntz, b timestamp_ntz").select(messages.within(F.col("a"), F.col("b"), 60_000), messages.within(F.col("a"), F.col("b"), 59_999)).first()[:] == (True, False)
