"""The broker's queries in DuckDB's SQL, over views named as the tables."""

from __future__ import annotations

from .plans.synthetic import LIFECYCLE, NOW
from .queries import DAY_MS, DEDUP_DAYS, _keys

_STEPS = ", ".join(f"({c}, {s}, '{t}', {'NULL' if a is None else a})" for c, s, t, a in LIFECYCLE)

_JOURNAL = f"""
subs0 AS (SELECT topic_id, i, 's-' || topic_id || '-' || i AS subscription_id, t0 + i * INTERVAL 10 DAY AS created_at
  FROM (SELECT DISTINCT event_type AS topic_id FROM events), (SELECT min(ts) AS t0 FROM events), range(3) r(i)),
subs AS (SELECT topic_id, i, subscription_id, 100 * min(event_id) - 1 AS ordering FROM subs0 JOIN events ON ts >= created_at GROUP BY 1, 2, 3),
msgs AS (SELECT event_id, event_type AS topic_id, 'm-' || event_id AS message_id, ts AS publish_time, props AS payload, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_id % 4 = 0 THEN ts + (60 + event_id % 600) * INTERVAL 1 SECOND END AS expire_time FROM events),
fan AS (SELECT m.*, s.subscription_id, s.i, 100 * m.event_id + 20 * s.i + 1 AS base, s.subscription_id || ':' || m.message_id AS ack_id, (m.event_id + s.i) % 10 AS c
  FROM msgs m JOIN subs s ON s.topic_id = m.topic_id AND 100 * m.event_id > s.ordering),
steps(c, step, type, attempt) AS (VALUES {_STEPS}),
later AS (SELECT fan.*, step, type, attempt, CASE WHEN type = 'MessageLeased' THEN publish_time + 30 * step * INTERVAL 1 SECOND WHEN type = 'AckDeadlineModified' THEN publish_time + INTERVAL 10 DAY END AS deadline
  FROM fan JOIN steps USING (c) WHERE (c <> 6 OR expire_time IS NOT NULL) AND (type <> 'AckDeadlineModified' OR event_id % 3 = 0)),
j AS (
  SELECT -100::BIGINT AS ordering, 'Topic|' || topic_id AS pid, 'TopicCreated' AS type, topic_id, NULL AS subscription_id, NULL AS ack_id, NULL AS message_id, NULL::TIMESTAMP AS publish_time, NULL::TIMESTAMP AS expire_time, NULL AS payload, NULL AS u, NULL::TIMESTAMP AS deadline, NULL::INTEGER AS attempt FROM (SELECT DISTINCT topic_id FROM msgs)
  UNION ALL SELECT 100 * event_id, 'Topic|' || topic_id, 'MessagePublished', NULL, NULL, NULL, message_id, publish_time, expire_time, payload, u, NULL, NULL FROM msgs
  UNION ALL SELECT ordering, 'Subscription|' || subscription_id, 'SubscriptionCreated', topic_id, subscription_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM subs
  UNION ALL SELECT base, 'Subscription|' || subscription_id, 'MessageDelivered', NULL, NULL, ack_id, message_id, publish_time, expire_time, payload, u, NULL, NULL FROM fan
  UNION ALL SELECT base + step, 'Subscription|' || subscription_id, type, NULL, NULL, ack_id, CASE WHEN type = 'MessageDeadLettered' THEN message_id END, CASE WHEN type = 'MessageDeadLettered' THEN publish_time END,
    CASE WHEN type = 'MessageDeadLettered' THEN expire_time END, CASE WHEN type = 'MessageDeadLettered' THEN payload END, CASE WHEN type = 'MessageDeadLettered' THEN u END, deadline, attempt FROM later),
a AS (SELECT split_part(pid, '|', 2) AS sub, *, type IN ('MessageAcknowledged', 'MessageDeadLettered', 'MessageExpired') AS gone FROM j WHERE ack_id IS NOT NULL),
life AS (SELECT sub, ack_id, max(ordering) FILTER (type = 'MessageDelivered') AS d, max(ordering) FILTER (gone) AS x FROM a GROUP BY 1, 2),
state AS (SELECT l.sub AS subscription_id, l.ack_id, l.d AS delivered,
    arg_max(a.message_id, a.ordering) FILTER (a.type = 'MessageDelivered') AS message_id, arg_max(a.publish_time, a.ordering) FILTER (a.type = 'MessageDelivered') AS publish_time, arg_max(a.payload, a.ordering) FILTER (a.type = 'MessageDelivered') AS payload,
    max(a.expire_time) FILTER (a.type = 'MessageDelivered') AS expire_time,
    CASE WHEN arg_max(a.type, a.ordering) FILTER (a.type IN ('MessageLeased', 'AckDeadlineModified', 'AckDeadlineExpired')) IN ('MessageLeased', 'AckDeadlineModified') THEN 'Leased' ELSE 'Available' END AS lease_state,
    arg_max(a.deadline, a.ordering) FILTER (a.type IN ('MessageLeased', 'AckDeadlineModified')) AS last_deadline,
    coalesce(arg_max(a.attempt, a.ordering) FILTER (a.type = 'AckDeadlineExpired'), 0) AS attempts
  FROM life l JOIN a ON a.sub = l.sub AND a.ack_id = l.ack_id AND a.ordering >= l.d WHERE l.d IS NOT NULL AND (l.x IS NULL OR l.d > l.x) GROUP BY 1, 2, 3),
o AS (SELECT subscription_id, ack_id, delivered, message_id, publish_time, payload, expire_time, lease_state, CASE WHEN lease_state = 'Leased' THEN last_deadline END AS deadline, attempts FROM state),
backlog AS (SELECT subscription_id, ack_id, publish_time AS delivered_at FROM o),
leases AS (SELECT sub AS subscription_id, ack_id, arg_max(deadline, ordering) FILTER (deadline IS NOT NULL) AS deadline FROM a WHERE type <> 'MessageDelivered' GROUP BY 1, 2 HAVING arg_max(type, ordering) IN ('MessageLeased', 'AckDeadlineModified')),
expiring AS (SELECT sub AS subscription_id, ack_id, max(expire_time) AS expire_time FROM a WHERE gone OR (type = 'MessageDelivered' AND expire_time IS NOT NULL) GROUP BY 1, 2 HAVING arg_max(type, ordering) = 'MessageDelivered'),
counters AS (SELECT split_part(pid, '|', 2) AS subscription_id, max(topic_id) AS topic_id, count(*) FILTER (type = 'AckDeadlineExpired') AS redelivered_total, count(*) FILTER (type = 'MessageDeadLettered') AS dead_lettered_total FROM j WHERE pid LIKE 'Subscription|%' GROUP BY 1),
sstats AS (SELECT c.subscription_id, topic_id, redelivered_total, dead_lettered_total, count(b.ack_id) AS backlog, min(delivered_at) AS oldest FROM counters c LEFT JOIN backlog b USING (subscription_id) GROUP BY 1, 2, 3, 4),
slist AS (SELECT subscription_id, topic_id, backlog, greatest(0, coalesce(date_sub('second', oldest, TIMESTAMP '{NOW}'), 0)) AS oldest_age_seconds, redelivered_total, dead_lettered_total FROM sstats),
tstats AS (SELECT split_part(pid, '|', 2) AS topic_id, count(*) FILTER (type = 'MessagePublished') AS published_total, bool_or(type = 'TopicDeleted') AS deleted FROM j WHERE pid LIKE 'Topic|%' GROUP BY 1),
due AS (SELECT o.* FROM o JOIN leases l USING (subscription_id, ack_id) WHERE l.deadline <= TIMESTAMP '{NOW}' AND lease_state = 'Leased' AND o.deadline <= TIMESTAMP '{NOW}'),
req AS (SELECT 's-' || event_type || '-' || i AS subscription_id, CASE WHEN again = 2 THEN ' ' ELSE 's-' || event_type || '-' || i || ':m-' || event_id END AS ack_id, event_id * 9 + i * 3 + again AS position, event_id % 5 * 10000 AS deadline_ms, event_id // 50 AS request
  FROM events, range(3) s(i), range(3) r(again) WHERE again = 0 OR (again = 1 AND event_id % 3 = 0) OR (again = 2 AND event_id % 5 = 0)),
split AS (SELECT r.*, o.ack_id IS NOT NULL AND trim(r.ack_id) <> '' AND position = min(position) OVER (PARTITION BY r.subscription_id, r.ack_id) AS known FROM req r LEFT JOIN o ON o.subscription_id = r.subscription_id AND o.ack_id = r.ack_id)
"""

_COMMANDS = """
cmd AS (SELECT o_orderkey AS ordering, 't-' || (o_custkey % 100) AS topic_id, CASE WHEN o_orderkey % 40 = 1 THEN 'Create' WHEN o_orderkey % 100 = 7 THEN 'Update' WHEN o_orderkey % 900 = 9 THEN 'Delete' ELSE 'Publish' END AS kind FROM orders),
made AS (SELECT topic_id, min(ordering) AS created FROM cmd WHERE kind = 'Create' GROUP BY 1),
ended AS (SELECT topic_id, min(ordering) AS deleted FROM cmd JOIN made USING (topic_id) WHERE kind = 'Delete' AND ordering > created GROUP BY 1),
dec AS (SELECT c.*, CASE WHEN kind = 'Create' THEN CASE WHEN ordering <> created THEN 'TopicAlreadyExists' END WHEN created IS NULL OR ordering < created OR ordering > coalesce(deleted, ordering) THEN 'TopicNotFound' END AS rejection FROM cmd c LEFT JOIN made USING (topic_id) LEFT JOIN ended USING (topic_id)),
tstate AS (SELECT topic_id, arg_max(ordering, ordering) FILTER (kind IN ('Create', 'Update'))::VARCHAR AS rev, bool_or(kind = 'Delete') AS deleted FROM dec WHERE rejection IS NULL GROUP BY 1)
"""

_DEDUP = f"""
p AS (SELECT event_type AS topic_id, 'm-' || event_id AS message_id, ts, json_extract_string(props, '$.k') AS k FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY topic_id, k ORDER BY ts, message_id) AS n FROM p),
acc AS (SELECT topic_id, k, message_id, ts, n FROM q WHERE n = 1
  UNION ALL SELECT topic_id, k, x.message_id, x.ts, x.n FROM (SELECT b.topic_id, b.k, (SELECT struct_pack(message_id := q.message_id, ts := q.ts, n := q.n) FROM q WHERE q.topic_id = b.topic_id AND q.k = b.k AND q.ts - INTERVAL {DEDUP_DAYS} DAY > b.ts ORDER BY q.n LIMIT 1) AS x FROM acc b) WHERE x IS NOT NULL),
dedup AS (SELECT q.topic_id, q.message_id, a.message_id AS original_id, q.message_id <> a.message_id AS deduplicated FROM q ASOF JOIN acc a ON q.topic_id = a.topic_id AND q.k = a.k AND q.n >= a.n)
"""

_CALLS = "seen AS (SELECT event_type AS subscription_id, user_id::VARCHAR AS consumer_id, max(ts) AS last_seen FROM events GROUP BY 1, 2), active AS (SELECT subscription_id, count(*) AS active_consumers FROM seen WHERE last_seen >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 5 DAY GROUP BY 1)"


def _j(select: str, *more: str) -> str:
    return f"WITH {', '.join([_JOURNAL, *more])} {select}"


def _c(select: str) -> str:
    return f"WITH {_COMMANDS} {select}"


_KEYS = ", ".join(f"({i}, '{k.tenant}', '{k.salt}', '{k.hash}', {str('admin' in k.scopes).lower()})" for i, k in enumerate(_keys()))

_ESC = "replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"


def _metric_lines() -> str:
    from .functions.exposition import BLOCKS, CONSUMER_METRICS, SUBSCRIPTION_METRICS, TOPIC_METRICS

    parts = []
    for metrics, view, column, label in ((SUBSCRIPTION_METRICS, "slist", "subscription_id", "subscription"), (TOPIC_METRICS, "tstats", "topic_id", "topic"), (CONSUMER_METRICS, "active", "subscription_id", "subscription")):
        for name, kind, text, c in metrics:
            n = BLOCKS.index(name)
            parts += [f"SELECT {n}::INTEGER AS block, '0' AS position, '# HELP broker_{name} {text}' AS line", f"SELECT {n}, '1', '# TYPE broker_{name} {kind}'", f"SELECT {n}, '2' || {column}, 'broker_{name}{{{label}=\"' || {column} || '\"}} ' || {c} FROM {view}"]
    return _j(" UNION ALL ".join(parts), _CALLS)


ORACLES = {
    "topic_stats": _j("SELECT * FROM tstats"),
    "subscription_stats": _j("SELECT * FROM sstats"),
    "subscription_listing_age": _j("SELECT * FROM slist"),
    "topic_listing": _j("SELECT * FROM tstats"),
    "outstanding_state": _j("SELECT subscription_id, ack_id, message_id, lease_state, deadline, attempts FROM o"),
    "backlog_view": _j("SELECT * FROM backlog"),
    "lease_index": _j("SELECT * FROM leases"),
    "expiry_index": _j("SELECT * FROM expiring"),
    "subscription_index": _j("SELECT topic_id, subscription_id FROM subs"),
    "subscriptions_per_topic": _j("SELECT topic_id, count(*) AS subscriptions FROM subs GROUP BY 1"),
    "fanout_delivery": _j("SELECT subscription_id, ack_id, 100 * event_id AS ordering, message_id FROM fan"),
    "pull_topk": _j(f"SELECT subscription_id, (row_number() OVER (PARTITION BY subscription_id ORDER BY delivered, ack_id))::INTEGER AS position, ack_id, payload, regexp_replace(strftime(publish_time, '%Y-%m-%dT%H:%M:%S.%f'), '\\.0+$', '') || 'Z' AS publish_time FROM o WHERE lease_state = 'Available' AND (expire_time IS NULL OR expire_time > TIMESTAMP '{NOW}') QUALIFY position <= 10"),
    "lease_events": _j(f"SELECT subscription_id, string_agg(ack_id, ',' ORDER BY n) AS ack_ids, TIMESTAMP '{NOW}' + INTERVAL 30 SECOND AS deadline FROM (SELECT subscription_id, ack_id, row_number() OVER (PARTITION BY subscription_id ORDER BY delivered, ack_id) AS n FROM o WHERE lease_state = 'Available' AND (expire_time IS NULL OR expire_time > TIMESTAMP '{NOW}')) WHERE n <= 100 GROUP BY 1"),
    "ack_applied": _j("SELECT subscription_id, ack_id, position, 'MessageAcknowledged' AS event FROM split WHERE known"),
    "ack_unknown": _j("SELECT subscription_id, ack_id, position, 'UnknownAckId' AS rejection FROM split WHERE NOT known"),
    "ack_batch_reply": _j("SELECT subscription_id, request, coalesce(string_agg(CASE WHEN known THEN ack_id END, ',' ORDER BY position), '') AS applied, count(*) FILTER (NOT known) AS n_unknown FROM split GROUP BY 1, 2"),
    "modify_deadline": _j(f"SELECT subscription_id, ack_id, position, CASE WHEN known THEN CASE WHEN deadline_ms <= 0 THEN 'AckDeadlineExpired' ELSE 'AckDeadlineModified' END END AS event, CASE WHEN known AND deadline_ms <= 0 THEN 0 END AS attempt, CASE WHEN known AND deadline_ms > 0 THEN TIMESTAMP '{NOW}' + deadline_ms * INTERVAL 1 MILLISECOND END AS deadline, CASE WHEN NOT known THEN 'UnknownAckId' END AS rejection FROM split"),
    "redelivery_sweep": _j("SELECT subscription_id, ack_id, CASE WHEN attempts + 1 >= 5 THEN 'MessageDeadLettered' ELSE 'AckDeadlineExpired' END AS event, attempts + 1 AS attempt FROM due"),
    "dead_letter_candidates": _j("SELECT subscription_id, ack_id, message_id, attempts + 1 AS attempt FROM due"),
    "dead_letter_messages": _j("SELECT 'view' AS topic_id, 'dead-letter:' || sub || ':' || message_id AS message_id, publish_time, NULL::TIMESTAMP AS expire_time, NULL::VARCHAR AS idempotency_key, sub AS h_subscription, attempt::VARCHAR AS h_attempts, message_id AS h_original, u AS user, 'Published' AS outcome FROM a WHERE type = 'MessageDeadLettered'"),
    "dead_letter_republish": _j("SELECT 'view' AS topic_id, 'dead-letter:' || sub || ':' || message_id AS message_id, sub AS source_subscription, attempt FROM a WHERE type = 'MessageDeadLettered' AND split_part(message_id, '-', 2)::BIGINT % 2 = 1"),
    "pull_twice_disjoint": _j(f"SELECT subscription_id, (n > 7)::INTEGER AS position, ack_id, n::INTEGER AS rank FROM (SELECT subscription_id, ack_id, row_number() OVER (PARTITION BY subscription_id ORDER BY delivered, ack_id) AS n FROM o WHERE lease_state = 'Available' AND (expire_time IS NULL OR expire_time > TIMESTAMP '{NOW}')) WHERE n <= 12"),
    "subscription_sets": _j("SELECT topic_id, string_agg(subscription_id, ',' ORDER BY subscription_id) AS subscription_ids FROM subs GROUP BY 1"),
    "ttl_sweep": _j(f"SELECT subscription_id, ack_id, 'MessageExpired' AS event FROM o JOIN expiring e USING (subscription_id, ack_id) WHERE e.expire_time <= TIMESTAMP '{NOW}' AND o.expire_time <= TIMESTAMP '{NOW}'"),
    "attempts_per_message": _j("SELECT subscription_id, ack_id, attempts FROM o WHERE attempts > 0"),
    "redelivery_counts": _j("SELECT subscription_id, redelivered_total, dead_lettered_total FROM counters"),
    "record_delivery_replay": _j("SELECT subscription_id, ack_id FROM fan ANTI JOIN o USING (subscription_id, ack_id)"),
    "existing_subscriptions": _j("SELECT DISTINCT subscription_id FROM (SELECT 's-' || event_type || '-' || (event_id % 5) AS subscription_id FROM events) SEMI JOIN subs USING (subscription_id)"),
    "topic_lookup": _j("SELECT subscription_id FROM subs WHERE topic_id = 'click'"),
    "topic_create_first_wins": _c("SELECT topic_id, ordering, rejection FROM dec WHERE kind = 'Create'"),
    "publish_rejections": _c("SELECT topic_id, ordering, rejection FROM dec WHERE kind = 'Publish' AND rejection IS NOT NULL"),
    "topic_delete_update": _c("SELECT topic_id, ordering, kind, rejection FROM dec WHERE kind IN ('Delete', 'Update')"),
    "topic_state": _c("SELECT * FROM tstate"),
    "topic_snapshot": _c("SELECT topic_id, rev FROM tstate WHERE NOT deleted"),
    "topic_events": _c("SELECT 'Topic|' || topic_id AS persistence_id, CASE kind WHEN 'Create' THEN 'TopicCreated' WHEN 'Publish' THEN 'MessagePublished' WHEN 'Delete' THEN 'TopicDeleted' ELSE 'TopicLabelsUpdated' END AS type, count(*) AS n FROM dec WHERE rejection IS NULL GROUP BY 1, 2"),
    "subscription_create": "SELECT o_orderkey AS ordering, 's-' || o_custkey AS subscription_id, CASE WHEN o_orderkey <> min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'SubscriptionAlreadyExists' END AS rejection FROM orders",
    "dedup_publish": f"WITH RECURSIVE {_DEDUP} SELECT * FROM dedup",
    "dedup_stats": f"WITH RECURSIVE {_DEDUP} SELECT topic_id, count(*) FILTER (deduplicated) AS duplicates, count(*) FILTER (NOT deduplicated) AS accepted FROM dedup GROUP BY 1",
    "consumer_last_seen": f"WITH {_CALLS} SELECT * FROM seen",
    "active_consumers": f"WITH {_CALLS} SELECT * FROM active",
    "tenant_qualify": "SELECT c_custkey, n_name || '~' || c_name AS internal, c_name AS external, false AS external_ok, starts_with(n_name || '~' || c_name, 'NATION_3~') AS is_own FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "tenant_listing": "SELECT c_custkey, c_name AS internal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
    "auth_match": f"WITH keys(n, tenant, salt, hash, admin) AS (VALUES {_KEYS}), t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'token-' || (s_suppkey % 7) WHEN s_suppkey % 2 = 0 THEN 'token-' || (s_suppkey % 5) END AS token FROM supplier), m AS (SELECT s_suppkey, min(n) AS n FROM t JOIN keys ON base64(unhex(sha256(from_base64(salt)::VARCHAR || token))) = hash GROUP BY 1) SELECT t.s_suppkey, keys.tenant, keys.n::INTEGER AS key_position, coalesce(keys.admin, false) AS admin FROM t LEFT JOIN m USING (s_suppkey) LEFT JOIN keys ON keys.n = m.n",
    "label_escape": "SELECT p_partkey, " + _ESC.format("p_name || CASE WHEN p_partkey % 3 = 0 THEN 'a\"b\\c' ELSE 'x' || chr(10) || 'y' END") + " AS escaped FROM part",
    "prometheus_lines": None,
    "ttl_expire_at": "SELECT event_id, ts + CASE WHEN event_id % 3 = 0 AND event_id % 5000 > 0 THEN event_id % 5000 // 1000 ELSE 90 END * INTERVAL 1 SECOND AS expire_time FROM events",
    "event_codec_roundtrip": _j("SELECT type, count(*) AS events, count(message_id) AS messages, sum(strlen(payload))::BIGINT AS payload_bytes, max(publish_time) AS last_publish, count(expire_time) AS expiries, max(deadline) AS last_deadline, count(ack_id) AS acks, sum(attempt)::BIGINT AS attempts FROM j GROUP BY 1"),
    "tag_routing": None,
    "persistence_id_parse": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN c_name END AS topic_id, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 5 <> 0 THEN c_name END AS subscription_id FROM customer",
    "snapshot_tail_equivalence": _j("SELECT subscription_id, ack_id, message_id, lease_state, deadline, attempts FROM o"),
    "retention_cutoff": _j("SELECT pid AS persistence_id, count(*) AS events, count(*) // 100 * 100 AS last_snapshot, greatest(0, count(*) // 100 * 100 - 100) AS cutoff FROM j GROUP BY 1"),
    "purged_journal": _j("SELECT pid AS persistence_id, count(*) - greatest(0, count(*) // 100 * 100 - 100) AS events, (greatest(0, count(*) // 100 * 100 - 100) + 1)::INTEGER AS first_seq FROM j GROUP BY 1"),
    "journal_counts": _j("SELECT pid AS persistence_id, count(*) AS events FROM j GROUP BY 1"),
    "supplier_backlog": "SELECT 's-' || s_suppkey AS subscription_id, s_nationkey::VARCHAR AS topic_id, 0::BIGINT AS redelivered_total, count(*) FILTER (l_returnflag = 'R') AS dead_lettered_total, count(*) FILTER (l_linestatus = 'O') AS backlog, min(l_shipdate) FILTER (l_linestatus = 'O') AS oldest FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey",
}


def _tags() -> str:
    from .schemas import TAGS

    values = ", ".join(f"('{t}', '{x}')" for t, xs in TAGS.items() for x in xs)
    return _j("SELECT tag, type, count(*) AS events FROM j LEFT JOIN tags USING (type) GROUP BY 1, 2", f"tags(tag, type) AS (VALUES {values})")


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"prometheus_lines": _metric_lines(), "tag_routing": _tags()}
