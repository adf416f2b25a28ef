"""The text format of metrics, version 0.0.4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The metrics in the order in which they are shown: (name after the prefix, kind, help, column, label).
SUBSCRIPTION_METRICS = [
    ("subscription_backlog", "gauge", "Outstanding messages of a subscription", "backlog"),
    ("subscription_oldest_unacked_age_seconds", "gauge", "Seconds since the oldest outstanding message was published", "oldest_age_seconds"),
    ("messages_redelivered_total", "counter", "Leases of a subscription that ran out or were given back", "redelivered_total"),
    ("messages_dead_lettered_total", "counter", "Messages of a subscription that were delivered too often", "dead_lettered_total"),
]
TOPIC_METRICS = [("messages_published_total", "counter", "Messages published to a topic", "published_total")]
CONSUMER_METRICS = [("subscription_consumers", "gauge", "Named consumers of a subscription seen within the window", "active_consumers")]
#: The order of the blocks on the page.
BLOCKS = ["subscription_backlog", "subscription_oldest_unacked_age_seconds", "messages_published_total", "messages_redelivered_total", "messages_dead_lettered_total", "subscription_consumers"]


def escaped(x: Column) -> Column:
    """A label's value: backslash first, then quotes and line breaks."""
    once = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(once, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def lines(df: DataFrame, metrics: list[tuple], label: str, column: str, prefix: str = "broker") -> DataFrame:
    """(block, position, line) for each metric: two comment lines, then a line for each row in the order of its label.

    Lines are placed by their labels, so no block is gathered in one task.
    """
    blocks = F.array(*[F.struct(F.lit(BLOCKS.index(name)).alias("block"), F.lit(f"{prefix}_{name}{{{label}=\"").alias("name"), F.col(c).cast("string").alias("value")) for name, _, _, c in metrics])
    body = df.select(F.col(column).alias("key"), F.explode(blocks).alias("m")).select(F.col("m.block").alias("block"), F.concat(F.lit("2"), "key").alias("position"), F.concat(F.col("m.name"), escaped(F.col("key")), F.lit('"} '), F.col("m.value")).alias("line"))
    heads = [(BLOCKS.index(name), f"{n}", line) for name, kind, text, _ in metrics for n, line in enumerate((f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}"))]
    head = df.sparkSession.createDataFrame(heads, "block int, position string, line string")
    return head.unionByName(body)


def exposition(lines: DataFrame) -> str:
    """The page: for a driver that serves it, so of as many lines as there are subscriptions and topics."""
    return "".join(f"{r['line']}\n" for r in lines.orderBy("block", "position").select("line").toLocalIterator())
