"""Idempotent publishing at scale: the anchored window of each key, over any number of tasks.

A publish is a duplicate of the last accepted one with its topic and key, if that lies within the window; duplicates don't
move the window. So acceptance is a chain, and a hot key's chain is one long dependence. It is cut by ranges instead:

1. (topic, key, time, id) are ranged over partitions and sorted there. A key that begins in a partition is folded at once.
   The first key of a partition may have begun before it; what its chain leaves behind is a step function of the anchor
   that comes in, and only the rows in which that function has steps matter.
2. The driver carries the anchor of each key from partition to partition: a few rows for each. A function with more than
   ``STEPS`` steps stays in the table and is looked up there, once for each partition in which the window ends.
3. The rows of first keys are folded with the anchors that come in.

Only times and ids travel; other columns are joined back by (topic, key, time, id), which no hot key can make hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.messages import micros
from ..storage import written

STEPS = 256
ROW, OPEN, STEP, LAST, FIRST = range(5)
_NAMES = ["kind", "part", "topic_id", "key", "t", "message_id", "original_id", "exit_t", "exit_id"]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
_SCHEMA = "kind int, part int, topic_id string, key string, t long, message_id string, original_id string, exit_t long, exit_id string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)], names=_NAMES)


def exits(t: np.ndarray, window: int) -> np.ndarray:
    """For each element of sorted times: the last element accepted if the chain passes it."""
    after = np.searchsorted(t, t + window, side="right")
    out = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            out[i] = out[after[i]]
    return out


def _first_pass(window: int):
    def run(batches):
        from pyspark import TaskContext

        part, group, first = TaskContext.get().partitionId(), None, None
        held: list[tuple[int, str]] = []  # the first key's rows
        at, anchor, out = None, None, []

        def opened():
            """The first key's rows with what their chain ends in, and the steps of that as a function of the anchor before."""
            t = np.array([x[0] for x in held], np.int64)
            end = exits(t, window)
            rows = [(OPEN, part, *first, x, i, None, held[e][0], held[e][1]) for (x, i), e in zip(held, end, strict=True)]
            reach = min(len(t), int(np.searchsorted(t, t[0] + window, side="right")) + 1)
            steps = [k for k in range(reach) if k + 1 == reach or end[k + 1] != end[k]]
            if len(steps) <= STEPS:
                rows += [(STEP, part, *first, int(t[k]), None, None, held[end[k]][0], held[end[k]][1]) for k in steps]
            rows.append((FIRST, part, *first, int(t[-1]), None, None, int(t[0]), str(len(steps))))
            return rows

        for batch in batches:
            for *key, t, i in zip(*(batch.column(c).to_pylist() for c in ("topic_id", "_key", "_t", "message_id")), strict=True):
                if first is None:
                    first = group = key
                if key != group:
                    group, at = key, None
                if group == first:
                    held.append((t, i))
                    continue
                if at is None or t > at + window:
                    at, anchor = t, i
                out.append((ROW, part, *key, t, i, anchor, None, None))
            if out:
                yield _batch(out)
                out = []
        if held:
            last = [] if group == first else [(LAST, part, *group, at, anchor, None, None, None)]
            for k in range(0, len(rows := opened() + last), 10_000):
                yield _batch(rows[k : k + 10_000])

    return run


def carried(table: DataFrame, window: int) -> dict[int, tuple[int, str]]:
    """The anchor (time, id) that comes into each partition from those before it, where its first key goes on."""
    rows = table.where(F.col("kind") >= STEP).orderBy("part", "kind", "t").collect()
    parts: dict[int, dict] = {}
    for r in rows:
        parts.setdefault(r["part"], {STEP: [], LAST: [], FIRST: []})[r["kind"]].append(r)
    state, into = None, {}
    for part in sorted(parts):
        (f,), steps, last = parts[part][FIRST], parts[part][STEP], parts[part][LAST]
        key = (f["topic_id"], f["key"])
        bound = None
        if state is not None and state[0] == key:
            into[part] = state[1]
            bound = state[1][0] + window
        # the first element after the bound begins the chain here; none may, if all lie within the window
        if bound is not None and f["t"] <= bound:
            left = state[1]
        elif steps:
            s = steps[0] if bound is None else next(s for s in steps if s["t"] > bound)
            left = (s["exit_t"], s["exit_id"])
        else:
            met = table.where((F.col("kind") == OPEN) & (F.col("part") == part) & (F.col("t") > (f["exit_t"] - 1 if bound is None else bound))).orderBy("t", "message_id").limit(1).collect()[0]
            left = (met["exit_t"], met["exit_id"])
        state = (key, left)
        if last:
            state = ((last[0]["topic_id"], last[0]["key"]), (last[0]["t"], last[0]["message_id"]))
    return into


def _second_pass(window: int, into: dict[int, tuple[int, str]]):
    def run(batches):
        part = at = anchor = None
        for batch in batches:
            out = []
            for p, topic, key, t, i in zip(*(batch.column(c).to_pylist() for c in ("part", "topic_id", "key", "t", "message_id")), strict=True):
                if p != part:
                    part, (at, anchor) = p, into.get(p, (None, None))
                if at is None or t > at + window:
                    at, anchor = t, i
                out.append((ROW, p, topic, key, t, i, anchor, None, None))
            yield _batch(out)

    return run


def originals(published: DataFrame, window_ms: int, parts: int | None = None) -> DataFrame:
    """(topic_id, _key, _t, message_id, original_id) of distinct keyed publishes with these first four columns."""
    window = window_ms * 1000
    parts = parts or int(published.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["topic_id", "_key", "_t", "message_id"]
    ranged = published.select(*order).distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(ranged.mapInArrow(_first_pass(window), _SCHEMA))
    into = carried(table, window)
    again = table.where(F.col("kind") == OPEN).repartition(parts, "part").sortWithinPartitions("part", "t", "message_id")
    done = table.where(F.col("kind") == ROW).unionByName(again.mapInArrow(_second_pass(window, into), _SCHEMA))
    return done.select("topic_id", F.col("key").alias("_key"), F.col("t").alias("_t"), "message_id", "original_id")


def deduplicated(published: DataFrame, window_ms: int, parts: int | None = None) -> DataFrame:
    """``published`` (topic_id, message_id, publish_time, key, ...) with ``original_id`` and ``deduplicated``.

    Order is (publish_time, message_id); a null or empty key is never a duplicate.
    """
    key = F.nullif(F.col("key"), F.lit(""))
    if window_ms <= 0:
        return published.select("*", F.col("message_id").alias("original_id"), F.lit(False).alias("deduplicated"))
    p = published.withColumn("_key", key).withColumn("_t", micros(F.col("publish_time")))
    keyed = p.where(F.col("_key").isNotNull())
    plain = p.where(F.col("_key").isNull()).select(*published.columns, F.col("message_id").alias("original_id"), F.lit(False).alias("deduplicated"))
    found = keyed.join(originals(keyed, window_ms, parts), ["topic_id", "_key", "_t", "message_id"])
    return found.select(*published.columns, "original_id", (F.col("original_id") != F.col("message_id")).alias("deduplicated")).unionByName(plain)


__all__ = ["carried", "deduplicated", "exits", "originals"]
