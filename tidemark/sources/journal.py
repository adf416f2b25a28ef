"""Where journals, commands and snapshots come from and go to: Parquet or JSON, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codec
from ..functions.ids import valid
from ..schemas import JOURNAL, SUBSCRIPTION_COMMANDS, TAGS, TOPIC_COMMANDS
from ..storage import hadoop_path


def commits(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(number, last ordering, batch) of what has been committed; each is an empty file in ``_commits`` named so."""
    fs, p = hadoop_path(spark, f"{path}/_commits")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName().split(".", 2) for s in fs.listStatus(p))
    return sorted((int(n), int(last), batch) for n, last, batch in names)


def append(events: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds events, which have their orderings, to a journal as one commit; False if ``batch`` had been committed before.

    A commit is a folder of its own, laid out by event type, so readers of a tag skip the others, and an attempt that
    failed is overwritten by the next one. There is one writer at a time, as there is one for each entity in a broker.
    """
    spark = events.sparkSession
    done = commits(spark, path)
    if batch is not None and any(b == batch for _, _, b in done):
        return False
    number = done[-1][0] + 1 if done else 0
    folder = f"{path}/commit={number}"
    events.write.mode("overwrite").partitionBy("type").parquet(folder)
    last = spark.read.schema(JOURNAL).parquet(folder).agg(F.max("ordering")).collect()[0][0]
    last = max([n for _, n, _ in done] + ([] if last is None else [last]), default=-1)
    fs, p = hadoop_path(spark, f"{path}/_commits/{number:09d}.{last}.{batch or ''}")
    fs.create(p).close()
    return True


def head(spark: SparkSession, path: str) -> int:
    """The highest ordering that has been committed; -1 before the first."""
    return max((last for _, last, _ in commits(spark, path)), default=-1)


def read(spark: SparkSession, path: str) -> DataFrame:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(f"{JOURNAL}, commit long").parquet(path).drop("commit")


def purge(spark: SparkSession, path: str, upto: int) -> int:
    """Deletes lease and deadline events of the commits that lie wholly up to an ordering, for which a snapshot stands; how many folders went.

    Deliveries, removals and expiries stay, as statistics and indexes are made from them.
    """
    gone = 0
    for number, last, _ in commits(spark, path):
        for kind in ("MessageLeased", "AckDeadlineModified"):
            fs, p = hadoop_path(spark, f"{path}/commit={number}/type={kind}")
            if last <= upto and fs.exists(p):
                gone += bool(fs.delete(p, True))
    return gone


def replay(spark: SparkSession, path: str, persistence_id: str, after: int = -(1 << 62)) -> DataFrame:
    """One aggregate's events in order, after a snapshot's ordering if there is one."""
    return read(spark, path).where((F.col("persistence_id") == persistence_id) & (F.col("ordering") > after)).orderBy("ordering")


def by_tag(spark: SparkSession, path: str, tag: str, after: int | None = None) -> DataFrame:
    """A tag's events; the filter on the type prunes directories."""
    j = read(spark, path).where(F.col("type").isin(TAGS[tag]))
    return j if after is None else j.where(F.col("ordering") > after)


def stream(spark: SparkSession, path: str, tag: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """The journal as a stream of its files; the offset is kept in the query's checkpoint."""
    r = spark.readStream.schema(f"{JOURNAL}, commit long")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    s = r.parquet(path).drop("commit")
    return s if tag is None else s.where(F.col("type").isin(TAGS[tag]))


def write_json(events: DataFrame, path: str) -> None:
    """Events as lines of {"ordering", "persistence_id", "event"}, with the event as it is on the wire."""
    codec.to_json(events).select("ordering", "persistence_id", F.col("json").alias("event")).write.mode("append").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("ordering long, persistence_id string, event string").json(path)
    return codec.from_json(raw, "event").drop("event")


def topic_commands(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(TOPIC_COMMANDS).format(fmt).load(path)


def subscription_commands(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(SUBSCRIPTION_COMMANDS).format(fmt).load(path)


def validated(df: DataFrame, ids: list[str]) -> DataFrame:
    """The rows whose ids aren't blank; others are dropped without an error, as in every read of a read model."""
    out = df
    for c in ids:
        out = out.where(valid(F.col(c)))
    return out


def write_snapshot(state: DataFrame, path: str, ordering: int, keep: int = 2) -> None:
    """Stores a state as of an ordering, and deletes all but the last ``keep`` ones."""
    state.write.mode("overwrite").parquet(f"{path}/at={ordering}")
    for old in snapshots(state.sparkSession, path)[:-keep]:
        fs, p = hadoop_path(state.sparkSession, f"{path}/at={old}")
        fs.delete(p, True)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The orderings of the whole snapshots, oldest first."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[3:]) for s in fs.listStatus(p) if fs.exists(hadoop_path(spark, f"{s.getPath()}/_SUCCESS")[1]))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The state of the highest ordering, with the column ``at``; None if there is none."""
    known = snapshots(spark, path)
    return spark.read.parquet(f"{path}/at={known[-1]}").withColumn("at", F.lit(known[-1])) if known else None
