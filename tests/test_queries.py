"""Every query with an oracle gives DuckDB's rows at the smallest scale; the rest of the library stands without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    expected = want.fetchall()
    assert expected, "an oracle without rows shows nothing"
    got = entry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    shown = lambda rows: sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    assert shown(tuple(r[c] for c in columns) for r in got.collect()) == shown(tuple(r[i] for i in order) for r in expected)


def test_requests_meet_every_case(spark, sf):
    q = entry.queries()
    events = q["modify_deadline"](spark, sf).groupBy("event").count().collect()
    assert {r["event"] for r in events} == {None, "AckDeadlineModified", "AckDeadlineExpired"}
    applied = q["ack_applied"](spark, sf)
    assert {r["subscription_id"][-1] for r in applied.select("subscription_id").distinct().collect()} == set("012")
    assert applied.count() == q["outstanding_state"](spark, sf).count()
    assert {r["attempts"] for r in q["attempts_per_message"](spark, sf).select("attempts").distinct().collect()} == {1, 2, 4}
    assert {(r["event"], r["attempt"]) for r in q["redelivery_sweep"](spark, sf).select("event", "attempt").distinct().collect()} >= {("AckDeadlineExpired", 1), ("AckDeadlineExpired", 3), ("MessageDeadLettered", 5)}
    assert q["tenant_qualify"](spark, sf).where("is_own").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['tidemark.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'topic_stats' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert not any(m.startswith('tidemark.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0
