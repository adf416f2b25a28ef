"""Concatenate and cut (operator 2): token streams of all documents in one row, cut into fixed windows.

First pass: every partition encodes its documents, writes their ids with their offset within the partition, and its
token total is summed. The totals' prefix sums are the partitions' global offsets; there are as many as input
partitions, so they fit on the driver. Second pass: every document's ids are cut where the global offset passes a
multiple of the window. A document across such a boundary gives one record on either side of it.

Defined results: a null text is empty, and an empty text is its end id alone; repeated rows and null ids are packed as
they come; an empty table gives no pieces; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, strings, written
from .vocabularies import encoder


def encoded(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: (part, id, start within the partition, n_tokens, ids of two or four bytes each)."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        e = encoder(vocabulary)
        end = np.array([end_id], f"<u{e.width}").tobytes()
        for batch in batches:
            ids = [x + end for x in e.encode(strings(batch, "_text"))]
            n = np.fromiter((len(x) // e.width for x in ids), np.int64, len(ids))
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part), pa.int32()), batch.column("_id"), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["part", "id", "start", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(run), f"part int, id {kind}, start long, n_tokens long, ids binary")


def pack(df: DataFrame, vocabulary: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``ids`` are unsigned little-endian 32-bit integers, as the checksum takes them. Sequence s holds the pieces with that
    ``sequence_id``, in the order of ``offset``; all are full but the last.
    """
    stored = written(encoded(df, vocabulary, end_id, id_col, text_col))
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each input partition
    bases, at = {}, 0
    for r in totals:
        bases[r["part"]] = at
        at += r["n"]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            rows: list = []
            for part, doc, start, n, raw in zip(*(cols[c] for c in ("part", "id", "start", "n_tokens", "ids")), strict=True):
                width = len(raw) // n
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                first = bases[part] + start
                cuts = [0, *range(window - first % window, n, window), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    x = ids[a:b].tobytes()
                    rows.append((doc, a, b - a, zlib.crc32(x), n, (first + a) // window, (first + a) % window, *((x,) if with_ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    types = [stored_type(stored, "id"), *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return stored.mapInArrow(lean(run), f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def stored_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
