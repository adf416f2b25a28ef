"""Streams end with the rows that the batch operators give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.broker import Broker
from tidemark.config import BrokerConfig
from tidemark.operators import delivery, readmodels
from tidemark.plans.synthetic import journal
from tidemark.schemas import JOURNAL
from tidemark.sources import journal as store
from tidemark.streaming import consume, dedup, leases, views


def in_parts(spark, sf, path, parts=3):
    j = journal(spark, sf).persist()
    top = j.agg(F.max("ordering")).first()[0] + 1
    for k in range(parts):
        j.where((F.col("ordering") >= top * k // parts - (200 if k == 0 else 0)) & (F.col("ordering") < top * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(path)
    return j


def test_views_are_the_batch_read_models(spark, sf, tmp_path):
    path = str(tmp_path / "journal")
    j = in_parts(spark, sf, path)
    for name, schema, step in (("topics", views.TOPIC_STATS, views.topic_stats_step), ("counters", views.COUNTERS, views.counters_step), ("leases", views.LEASES, views.leases_step), ("expiring", views.EXPIRING, views.expiring_step), ("backlog", views.BACKLOG, views.backlog_step), ("subscriptions", views.SUBSCRIPTIONS, views.subscriptions_step)):
        q = views.maintained(store.stream(spark, path, files_per_trigger=1), str(tmp_path / name), schema, step, str(tmp_path / f"{name}-checkpoint"))
        q.awaitTermination()
        got = views.current(spark, str(tmp_path / name), schema)
        want = {"topics": readmodels.topic_stats, "counters": readmodels.subscription_counters, "leases": readmodels.leases, "expiring": readmodels.expiring, "backlog": readmodels.backlog, "subscriptions": delivery.subscription_index}[name](j)
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
        assert len(views._versions(spark, str(tmp_path / name))) == 2


def test_dedup_on_a_stream(spark, tmp_path):
    t0 = datetime(2026, 7, 7)
    pubs = [("t", f"m-{i:02}", t0 + timedelta(seconds=20 * i), "k") for i in range(12)] + [("t", f"n-{i}", t0, [None, ""][i % 2]) for i in range(4)]
    schema = "topic_id string, message_id string, publish_time timestamp_ntz, key string"
    for k in range(3):
        spark.createDataFrame(pubs[4 * k : 4 * k + 4] + pubs[12:] * (k == 2), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = dedup.deduplicated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 60_000)
    q = s.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["message_id"]: r["original_id"] for r in spark.table("dedup_out").collect()}
    assert got == {f"m-{i:02}": f"m-{i // 4 * 4:02}" for i in range(12)} | {f"n-{i}": f"n-{i}" for i in range(4)}


def test_lease_timers(spark, tmp_path):
    t0 = datetime(2026, 7, 7)
    m = ("m", b"x", {}, t0, None, None)
    event = lambda o, kind, ack=None, acks=None, deadline=None, sec=0: (int(o * 2), "Subscription|s", kind, None, None, None, m if kind == "MessageDelivered" else None, ack, acks, None if deadline is None else t0 + timedelta(seconds=deadline), None, t0 + timedelta(seconds=sec))
    batches = [
        [event(0, "MessageDelivered", "a"), event(1, "MessageDelivered", "b"), event(2, "MessageLeased", acks=["a", "b"], deadline=30)],
        [event(3, "MessageAcknowledged", "b", sec=10)],
        [event(3.5, "AckDeadlineModified", "b", deadline=40, sec=12)],
        [event(4, "MessageDelivered", "c", sec=100)],
        [event(5, "MessageDelivered", "d", sec=200)],
    ]
    schema = JOURNAL + ", written timestamp"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = leases.expiries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), max_attempts=5)
    q = s.writeStream.format("memory").queryName("lease_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("lease_out").collect()] == [("s", "a", "AckDeadlineExpired", 1)]


def test_journal_files(spark, sf, tmp_path):
    j = journal(spark, sf)
    store.append(j, str(tmp_path / "p"))
    assert store.read(spark, str(tmp_path / "p")).count() == j.count()
    tagged = store.by_tag(spark, str(tmp_path / "p"), "topic-message")
    assert tagged.count() == 1000
    pruned = tagged._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "type" in pruned and "MessagePublished" in pruned
    one = store.replay(spark, str(tmp_path / "p"), "Topic|click").collect()
    assert [r["ordering"] for r in one] == sorted(r["ordering"] for r in one) and len(one) > 100
    store.write_json(j, str(tmp_path / "j"))
    back = store.read_json(spark, str(tmp_path / "j"))
    assert back.groupBy("type").count().orderBy("type").collect() == j.groupBy("type").count().orderBy("type").collect()
    assert store.latest_snapshot(spark, str(tmp_path / "none")) is None
    store.write_snapshot(readmodels.leases(j), str(tmp_path / "s"), 5)
    store.write_snapshot(readmodels.leases(j).limit(3), str(tmp_path / "s"), 9)
    assert store.latest_snapshot(spark, str(tmp_path / "s")).count() == 3


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """A view's step and a broker's commit, run again under the same batch, change nothing."""
    b = Broker(spark, str(tmp_path / "journal"))
    topic = spark.createDataFrame([("t", "Create", {}, 0)], "topic_id string, kind string, labels map<string,string>, position long")
    b.topic_command(topic)
    made = spark.createDataFrame([("s", "t", 0)], "subscription_id string, topic_id string, position long")
    b.create_subscription(made, batch="a")
    assert b.create_subscription(made, batch="a").first()["outcome"] == "SubscriptionAlreadyExists"
    pub = spark.createDataFrame([("t", "m-1", b"x", 0)], "topic_id string, message_id string, payload binary, position long")
    for _ in range(2):
        b.publish(pub, "2026-07-07 00:00:00", batch="p")
        b.deliver(batch="d")
    assert b.journal().count() == 4 and len(store.commits(spark, b.path)) == 4


def test_consuming_as_a_stream(spark, tmp_path):
    config = BrokerConfig(stream_batch=3, max_delivery_attempts=1, dead_letter_topic="dlq")
    b = Broker(spark, str(tmp_path / "journal"), config)
    b.topic_command(spark.createDataFrame([("t", "Create", {}, 0), ("dlq", "Create", {}, 1)], "topic_id string, kind string, labels map<string,string>, position long"))
    b.create_subscription(spark.createDataFrame([("s", "t", 0), ("dead", "dlq", 1)], "subscription_id string, topic_id string, position long"))
    b.publish(spark.createDataFrame([("t", f"m-{i}", b"x", i) for i in range(8)], "topic_id string, message_id string, payload binary, position long"), "2026-07-07 00:00:00")

    def run(stream, act, name):
        consume.driven(stream, act, str(tmp_path / name)).awaitTermination()

    run(store.stream(spark, b.path), consume.together(consume.fan_out(b), consume.dead_letters(b)), "fan")
    assert b.state().count() == 8
    clock = "now timestamp_ntz"
    for k in range(4):  # ten seconds apart; the last finds nothing to lease
        spark.createDataFrame([(datetime(2026, 7, 7, 0, 0, 10 * k),)], clock).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    times = spark.readStream.schema(clock).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    out = str(tmp_path / "out")
    run(times, consume.leased(b, "s", out, consumer_id="c"), "lease")
    got = spark.read.parquet(out).orderBy("v", "rank").collect()
    assert [(r["v"], r["ack_id"]) for r in got] == [(i // 3, f"s:m-{i}") for i in range(8)]
    consume.leased(b, "s", out, consumer_id="c")(spark.createDataFrame([(datetime(2026, 7, 7),)], clock), 0)  # again: nothing new
    assert spark.read.parquet(out).count() == 8 and b.calls().select("consumer_id").distinct().count() == 1
    ack = "subscription_id string, ack_id string, position long"
    spark.createDataFrame([("s", f"s:m-{i}", i) for i in range(5)] + [("s", "s:m-0", 9), ("zz", "q", 10)], ack).write.parquet(str(tmp_path / "acks"))
    run(spark.readStream.schema(ack).parquet(str(tmp_path / "acks")), consume.acknowledged(b), "ack")
    assert b.state().count() == 3
    spark.createDataFrame([(datetime(2026, 7, 7, 1),)], clock).write.parquet(str(tmp_path / "late"))
    run(spark.readStream.schema(clock).parquet(str(tmp_path / "late")), consume.swept(b), "sweep")
    assert b.state().count() == 0
    for _ in range(2):  # the letters, then their delivery
        run(store.stream(spark, b.path), consume.together(consume.fan_out(b), consume.dead_letters(b)), "fan")
    assert sorted(r["ack_id"] for r in b.state().collect()) == [f"dead:dead-letter:s:m-{i}" for i in (5, 6, 7)]
    try:
        consume.leased(b, "nobody", out)
        raise AssertionError
    except LookupError as e:
        assert "NOT_FOUND" in str(e)
    assert consume.ticks(spark).isStreaming


def test_a_broker_that_keeps_itself(spark, tmp_path):
    """One query delivers, sweeps, republishes and takes snapshots; a poller leases by the real clock."""
    b = Broker(spark, str(tmp_path / "journal"), BrokerConfig(max_delivery_attempts=1, dead_letter_topic="dlq", snapshot_every=1, poll_interval_ms=500))
    b.topic_command(spark.createDataFrame([("t", "Create", {}, 0), ("dlq", "Create", {}, 1)], "topic_id string, kind string, labels map<string,string>, position long"))
    b.create_subscription(spark.createDataFrame([("s", "t", 0), ("dead", "dlq", 1)], "subscription_id string, topic_id string, position long"))
    b.publish(spark.createDataFrame([("t", "m-1", b"x", 0)], "topic_id string, message_id string, payload binary, position long"), "2026-07-07 00:00:00")

    def tick(hour):
        spark.createDataFrame([(datetime(2026, 7, 7, hour),)], "now timestamp_ntz").write.mode("append").parquet(str(tmp_path / "ticks"))
        consume.background(b, str(tmp_path / "keep"), spark.readStream.schema("now timestamp_ntz").parquet(str(tmp_path / "ticks"))).awaitTermination()

    tick(1)
    assert [r["ack_id"] for r in b.state().collect()] == ["s:m-1"] and store.snapshots(spark, f"{b.path}/_snapshots")
    b.pull(spark.createDataFrame([("s", 0)], "subscription_id string, position long"), "2026-07-07 01:00:00")
    tick(2)
    assert [r["ack_id"] for r in b.state().collect()] == ["dead:dead-letter:s:m-1"]
    q = consume.polling(b, "dead", str(tmp_path / "out"), str(tmp_path / "poll"), consumer_id="c")
    for _ in range(60):
        q.awaitTermination(1)
        if b.state().where("lease_state = 'Leased'").count():
            break
    q.stop()
    assert [r["ack_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["dead:dead-letter:s:m-1"]
