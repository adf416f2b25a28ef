"""What the corpus operators share: the shared folder, written tables, bounded memos and safe text units."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Unicode White_Space, spelled out so that every regular expression here means the same characters.
SPACES = "\t-\r \x85\xa0  -     　"

_FOLDERS: set[str] = set()
#: The folders made within each open ``scratch``, innermost last.
_SCRATCH: list[list[str]] = []

#: ASCII white space: what separates words in the contracts, and what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new name in a folder that the driver and all executors see; what lies there goes when the application ends.

    It is in ``spark.checkpoint.dir``. Only on a local master, where all tasks run in one process, a folder of this
    machine takes its place if that setting is absent; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError(f"spark.checkpoint.dir has to name shared storage on {master}")
        root = "file:///tmp/tidemark-shared"
    top = f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    if top not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS.add(top)
    made = f"{top}/{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(made)
    return made


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The shared folders made inside are deleted at the end: for steps whose result has been written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            delete_folder(spark, folder)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._folder = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` has written, once nothing that is still to be computed reads it."""
    for t in tables:
        if folder := getattr(t, "_folder", None):
            delete_folder(t.sparkSession, folder)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones equals, in any case of letters."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def salted(big: DataFrame, small: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join whose large side may have hot keys: its rows of one key are dealt to ``salts`` tasks, the small side's rows repeat."""
    salt = fresh("_salt", [*big.columns, *small.columns])
    left = big.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


def filesystem(uri: str):
    """(file system, path) for a URI of the shared folder, for the operators whose files are not Spark tables."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.FileSystem.from_uri(uri)


class Memo:
    """A memo of two generations, each of a bounded number of bytes: when the young one is full, it becomes the old one.

    ``fill(keys)`` returns the values of keys that neither generation holds. What is often used moves back
    into the young generation, so common words stay while words that came once go. Keys longer than ``LONG`` and their
    values are never held, so texts without spaces cost no memory beyond their own call.
    """

    LONG = 256
    #: Bytes of an entry beside the lengths of its key and value: two objects, and a dictionary's slot.
    ENTRY = 200

    def __init__(self, fill, limit: int = 80 << 20, weigh=len):
        self.fill, self.limit, self.weigh = fill, limit, weigh
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def rows(self, groups: list[list]) -> list[list]:
        """The values of each group's keys. Values are never None."""
        known, todo, out, holes = self.young.get, set(), [], []
        for keys in groups:
            values = list(map(known, keys))
            if None in values:
                at = [i for i, v in enumerate(values) if v is None]
                todo.update([keys[i] for i in at])
                holes.append((values, keys, at))
            out.append(values)
        if todo:
            found = {k: self.old[k] for k in todo if k in self.old} if self.old else {}
            new = [k for k in todo if k not in found]
            found.update(zip(new, self.fill(new), strict=True))
            self._hold(found)
            for values, keys, at in holes:
                for i in at:
                    values[i] = found[keys[i]]
        return out

    def _hold(self, found: dict) -> None:
        short = found if max(map(len, found)) <= self.LONG else {k: v for k, v in found.items() if len(k) <= self.LONG}
        size = sum(map(len, short)) + sum(map(self.weigh, short.values())) + self.ENTRY * len(short)
        if self.young and self.held + size > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        if size <= self.limit:
            self.young.update(short)
            self.held += size
            return
        for k, v in short.items():  # one call's keys alone pass the limit: as many as fit
            self.held += len(k) + self.weigh(v) + self.ENTRY
            if self.held > self.limit:
                return
            self.young[k] = v


def lean(run):
    """A function of Arrow batches whose worker gives freed memory back to the system at the end of the task.

    Workers outlive their tasks, and what they keep is missing to the tasks of other stages on the same executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def in_groups(texts: list, limit: int = 1 << 20) -> Iterator[range]:
    """Ranges of consecutive texts of at most ``limit`` characters together, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield range(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield range(start, len(texts))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column of a batch; null is the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def byte_strings(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of a batch in UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def unit_pattern(spaces: str = SPACES) -> re.Pattern:
    """Words with the one space before them, and runs of white space: a coarsening of the byte-level pre-tokenizer's pieces."""
    return re.compile(rf" ?[^{spaces}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
