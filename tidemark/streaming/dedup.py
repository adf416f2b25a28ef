"""Idempotent publishing on a stream: the anchored window of a topic and key, kept in state.

The batch form (``operators.topics.deduplicated``) folds all publishes of a key; here the anchor of each key is state,
which a timer drops once the watermark has passed its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.messages import micros

OUT = "topic_id string, key string, message_id string, original_id string, deduplicated boolean"


def deduplicated(published: DataFrame, window_ms: int, lateness: str = "1 minute") -> DataFrame:
    """``published``: a stream (topic_id, message_id, publish_time, key), in order of time by batches. Publishes without a key, or with an empty one, go around the state."""
    window = window_ms * 1000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, first = state.get if state.exists else (None, None)
        rows = sorted((t, m) for b in batches for t, m in zip(b["micros"], b["message_id"], strict=True))
        out = []
        for t, m in rows:
            dup = at is not None and at >= t - window
            if not dup:
                at, first = int(t), m
            out.append((key[0], key[1], m, first, dup))
        state.update((at, first))
        state.setTimeoutTimestamp(max(at // 1000 + window_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["topic_id", "key", "message_id", "original_id", "deduplicated"])

    timed = published.withColumn("at", F.col("publish_time").cast("timestamp")).withColumn("micros", micros(F.col("publish_time"))).withWatermark("at", lateness)
    keyless = F.length(F.coalesce("key", F.lit(""))) == 0
    plain = timed.where(keyless).select("topic_id", "key", "message_id", F.col("message_id").alias("original_id"), F.lit(False).alias("deduplicated"))
    return plain.unionByName(_keyed(timed.where(~keyless), fold))


def _keyed(timed: DataFrame, fold) -> DataFrame:
    return timed.groupBy("topic_id", "key").applyInPandasWithState(fold, OUT, "at long, first string", "append", GroupStateTimeout.EventTimeTimeout)
