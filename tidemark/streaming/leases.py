"""Leases with timers: a stream of lease, acknowledgement and deadline events gives expiries and dead letters.

Each outstanding (subscription, ack id) holds its deadline and attempts; its timer fires when the watermark passes the
deadline. State begins with the delivery and ends with the removal, and lease events without it are ignored, so one that
comes after an acknowledgement does nothing. The stream has to begin with the journal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.messages import micros
from ..schemas import TERMINAL

OUT = "subscription_id string, ack_id string, event string, attempt int"


def expiries(journal: DataFrame, max_attempts: int = 5, lateness: str = "0 seconds") -> DataFrame:
    """AckDeadlineExpired or MessageDeadLettered for every lease whose deadline the stream's time has passed.

    ``journal``: a stream with ``written`` (timestamp), the time at which each event was journaled.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deadline, attempts = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            attempt = attempts + 1
            dead = 0 < max_attempts <= attempt
            if dead:
                state.remove()
            else:
                state.update((None, attempt))
            yield pd.DataFrame([(key[0], key[1], "MessageDeadLettered" if dead else "AckDeadlineExpired", attempt)], columns=["subscription_id", "ack_id", "event", "attempt"])
            return
        there = state.exists
        for _, kind, at, attempt in sorted(r for b in batches for r in zip(b["ordering"], b["type"], b["due"], b["attempt"], strict=True)):
            if kind == "MessageDelivered":
                there, deadline, attempts = True, None, 0
            elif kind in TERMINAL:
                there = False
            elif there and kind == "AckDeadlineExpired":
                deadline, attempts = None, int(attempt)
            elif there:
                deadline = int(at)
        if there:
            state.update((deadline, attempts))
            if deadline is not None:
                state.setTimeoutTimestamp(max(deadline // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    timed = journal.withWatermark("written", lateness)
    return _by_ack(timed).groupBy("subscription_id", "ack_id").applyInPandasWithState(step, OUT, "deadline long, attempts int", "append", GroupStateTimeout.EventTimeTimeout)


def _by_ack(timed: DataFrame) -> DataFrame:
    """``by_ack`` that keeps the event time."""
    from ..functions.ids import parsed
    from ..operators.subscriptions import LEASE_EVENTS

    j = timed.where(F.col("type").isin("MessageDelivered", *LEASE_EVENTS, *TERMINAL))
    rows = j.select(parsed("Subscription", F.col("persistence_id")).alias("subscription_id"), F.explode(F.coalesce("ack_ids", F.array("ack_id"))).alias("ack_id"), "ordering", "type", F.coalesce(micros(F.col("deadline")), F.lit(0)).alias("due"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "written")
    return rows.where(F.col("subscription_id").isNotNull())
