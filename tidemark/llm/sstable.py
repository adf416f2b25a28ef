"""Sorted-string-table shards of token ids (operator 9).

A shard file holds documents in the order of their keys: blocks of prefix-compressed entries, a sparse index with the
first key of every block, a Bloom filter over the keys, and a footer of fixed size at the end. A lookup asks the filter,
finds the block by binary search in the index, and reads that block alone.

    block   zstd of: entries of (shared, rest, value length as varints, rest of the key, value), first entry unshared
    index   per block: key length (2 bytes), key, offset (8), stored length (4), tokens before it in the shard (8)
    bloom   bits; bit k of a key: (h1 + k * h2) mod size, h1 and h2 the halves of its xxh3-128
    footer  index offset, index length, bloom offset, bloom length, documents, tokens (8 each), id width, hashes (4 each), magic (8)

Documents are encoded where they lie, and their ids ranged by key over the shards, so shard files in the order of their
numbers hold all keys in order. The ranges' borders come from a sample of keys, weighed by the bytes of their texts; the
sample only decides how even the shards are. Rows that repeat more often than a shard holds are dealt over several. A task
writes under a name of its own and then renames; a repeated task writes the same bytes.

Defined results: a null text is empty, and an empty text is its end id alone; a null key sorts first; repeated keys stay,
ordered by the text's hash; an empty table gives no documents; columns other than the two named are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import filesystem, lean, shared_folder, strings
from .packing import stored_type
from .vocabularies import encoder, id_width

MAGIC = b"TMSSTBL1"
FOOTER = struct.Struct("<6Q2I8s")
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7
#: Bytes of text of a shard, at most in the mean and at least where there are partitions enough.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 1 << 20
#: Keys drawn to find the borders between shards: for each shard, in the mean, and at most in all.
SAMPLES, ALL_SAMPLES = 100, 1_000_000
#: Characters of texts that are encoded at a time: half of the usual, as the same executors sort and shuffle meanwhile.
GROUP = 1 << 22


def key_of(value) -> bytes:
    """A key whose byte order is the order of the values, null first."""
    if value is None:
        return b"\0"
    return b"\1" + (value.encode() if isinstance(value, str) else struct.pack(">Q", int(value) + (1 << 63)))


def value_of(key: bytes, text: bool):
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64


def bloom_bits(key: bytes, size: int) -> list[int]:
    one, two = key_hashes(key)
    return [(one + k * two) % size for k in range(HASHES)]


class ShardWriter:
    """Writes entries that come in key order to a binary stream. Of a key, 16 bytes of hash stay in memory for the filter."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.width, self.block_bytes, self.zip = out, width, block_bytes, zstandard.ZstdCompressor(level=1)
        self.block = bytearray()
        self.index = bytearray()
        self.hashes = array("Q")
        self.last = self.first = b""
        self.offset = self.tokens = self.before = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.block:
            self.first, self.last, self.before = key, b"", self.tokens
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:]
        self.block += ids
        self.last = key
        self.hashes.extend(key_hashes(key))
        self.tokens += len(ids) // self.width
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = self.zip.compress(bytes(self.block))
            self.index += struct.pack("<H", len(self.first)) + self.first + struct.pack("<QIQ", self.offset, len(raw), self.before)
            self.out.write(raw)
            self.offset += len(raw)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        documents = len(self.hashes) // 2
        size = max(64, documents * BITS_PER_KEY + 7 & ~7)
        bloom = np.zeros(size // 8, np.uint8)
        halves = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2) % np.uint64(size)  # so the sums below stay in 64 bits
        for k in range(HASHES):
            at = (halves[:, 0] + np.uint64(k) * halves[:, 1]) % np.uint64(size)
            np.bitwise_or.at(bloom, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.out.write(bytes(self.index) + bloom.tobytes())
        self.out.write(FOOTER.pack(self.offset, len(self.index), self.offset + len(self.index), len(bloom), documents, self.tokens, self.width, HASHES, MAGIC))


class Shard:
    """A shard file, open for lookups and scans: only footer, index and filter are in memory."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        io, il, bo, bl, self.documents, self.tokens, self.width, self.hashes, magic = FOOTER.unpack(self.at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bloom = self.at(bo, bl)
        raw, k = self.at(io, il), 0
        self.firsts, self.blocks = [], []
        while k < len(raw):
            (n,) = struct.unpack_from("<H", raw, k)
            self.firsts.append(raw[k + 2 : k + 2 + n])
            self.blocks.append(struct.unpack_from("<QIQ", raw, k + 2 + n))
            k += 22 + n

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def entries(self, block: int):
        """(key, ids) of a block."""
        import zstandard

        offset, n, _ = self.blocks[block]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.at(offset, n)), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def scan(self):
        for b in range(len(self.blocks)):
            yield from self.entries(b)

    def get(self, value) -> list[np.ndarray]:
        """The id sequences of all documents with this key."""
        key = key_of(value)
        size = len(self.bloom) * 8
        if not self.blocks or any(not self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, size)):
            return []
        b = bisect_right(self.firsts, key) - 1
        while b > 0 and self.firsts[b] == key:
            b -= 1
        out = []
        for b in range(max(b, 0), len(self.blocks)):
            if self.firsts[b] > key:
                break
            out += [np.frombuffer(ids, f"<u{self.width}") for k, ids in self.entries(b) if k == key]
        return out

    def close(self) -> None:
        self.file.close()


class Shards:
    """What was written: a row of the manifest for each shard, in key order. A shard is some hundred megabytes, so the manifest is short."""

    def __init__(self, spark: SparkSession, rows: list[dict], id_type: pa.DataType, id_col: str):
        self.spark, self.id_type, self.id_col = spark, id_type, id_col
        self.rows = sorted(rows, key=lambda r: r["part"])
        start = 0
        for r in self.rows:
            r["start"] = start
            start += r["tokens"]

    def lookup(self, value) -> list[np.ndarray]:
        """The ids of a document, from the one or few shards whose key range holds it."""
        key, out = key_of(value), []
        for r in self.rows:
            if r["low"] <= key <= r["high"]:
                shard = Shard(r["path"])
                out += shard.get(value)
                shard.close()
        return out

    def read(self) -> DataFrame:
        """(id, start, n_tokens, ids_crc32) of every document, from the files; a task for each shard, which it reads block by block."""
        name, kind = self.id_col, self.id_type
        text = pa.types.is_string(kind)

        def run(batches):
            for batch in batches:
                for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                    shard = Shard(path)
                    for b in range(len(shard.blocks)):
                        out = []
                        for key, ids in shard.entries(b):
                            n = len(ids) // shard.width
                            out.append((value_of(key, text), at, n, zlib.crc32(np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes())))
                            at += n
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *[pa.int64()] * 3], strict=True)], names=[name, "start", "n_tokens", "ids_crc32"])
                    shard.close()

        from pyspark.sql.pandas.types import from_arrow_type

        schema = f"`{name}` {from_arrow_type(kind).simpleString()}, start long, n_tokens long, ids_crc32 long"
        n = len(self.rows)
        files = self.spark.createDataFrame([(k, r["path"], r["start"]) for k, r in enumerate(self.rows)], "place int, path string, start long")
        return files.repartitionById(max(n, 1), "place").mapInArrow(lean(run), schema)


def shard_count(df: DataFrame, text_col: str) -> int:
    """As many shards as ``SHARD_BYTES`` of text ask for; of smaller tables as many as there are shuffle partitions, but no shard below ``LEAST_BYTES``."""
    size = df.agg(F.sum(F.octet_length(text_col))).collect()[0][0] or 0
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // SHARD_BYTES), min(parallel, -(-size // LEAST_BYTES)))


def borders(keys: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """The first (key, hash) of every shard but the first, so that shards hold about as many bytes; from (_id, _hash, _size).

    A border that comes several times has shards of its own between its occurrences.
    """
    share = min(SAMPLES * shards, ALL_SAMPLES) / max(keys.count(), 1)
    drawn = sorted((key_of(r["_id"]), r["_hash"], r["_size"]) for r in (keys.sample(share, seed=1) if share < 1 else keys).collect())
    total, at, out = sum(size for *_, size in drawn), 0, []
    full = total / shards
    for key, h, size in drawn:
        if at >= full:
            out.append((key, h))
            full = (at * shards // total + 1) * total / shards
        at += size
    return out


def shard_of(key: tuple[bytes, int], cuts: list[tuple[bytes, int]], turn: int) -> int:
    """The shard of a row; rows equal to a repeated border take turns, as their order among themselves is free."""
    low, high = bisect_left(cuts, key), bisect_right(cuts, key)
    return high if high - low < 2 else low + turn % (high - low + 1)


def write_shards(df: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Shards:
    """Encodes all documents into shard files in ``folder`` (by default a new one in the shared folder)."""
    spark = df.sparkSession
    folder, width, shards = folder or shared_folder(spark), id_width(vocabulary), shard_count(df, text_col)
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    cuts = borders(rows.select("_id", "_hash", (F.coalesce(F.octet_length("_text"), F.lit(0)) + 16).alias("_size")), shards)

    def encoded(batches):
        e = encoder(vocabulary, group=GROUP)
        end = np.array([end_id], f"<u{width}").tobytes()
        turn = 0
        for batch in batches:
            ids = [x + end for x in e.encode(strings(batch, "_text"))]
            keys = zip(map(key_of, batch.column("_id").to_pylist()), batch.column("_hash").to_pylist(), strict=True)
            place = [shard_of(k, cuts, turn + i) for i, k in enumerate(keys)]
            turn += len(place)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column("_id"), batch.column("_hash"), pa.array(ids, pa.binary())], names=["_place", "_id", "_hash", "_ids"])

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        own, path = f"{root}/_{part:06d}-{context.taskAttemptId()}", f"{root}/shard-{part:06d}.sst"
        low = None
        with fs.open_output_stream(own, compression=None) as out:
            w = ShardWriter(out, width)
            for batch in batches:
                for value, ids in zip(batch.column("_id").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                    key = key_of(value)
                    low = key if low is None else low
                    w.add(key, ids)
            w.close()
        fs.move(own, path)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, f"{folder}/shard-{part:06d}.sst", w.tokens, low, w.last)], names=["part", "path", "tokens", "low", "high"])

    ids = rows.mapInArrow(lean(encoded), f"_place int, _id {df.schema[id_col].dataType.simpleString()}, _hash long, _ids binary")
    ranged = ids.repartitionById(shards, "_place").sortWithinPartitions(F.col("_id").asc_nulls_first(), "_hash").select("_id", "_ids")
    made = ranged.mapInArrow(lean(run), "part long, path string, tokens long, low binary, high binary").collect()  # a row for each shard
    return Shards(spark, [{**r.asDict(), "low": bytes(r["low"]), "high": bytes(r["high"])} for r in made], stored_type(df, id_col), id_col)
