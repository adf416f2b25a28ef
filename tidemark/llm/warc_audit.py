"""WARC files and their Merkle fixity audit (operator 8).

Pages become gzip members of WARC files, a file for each task, with an index of offsets. For a replica, every record's
byte range is hashed (together with its offset and length), after them what the file holds beyond its records, up to its true
end, and every ``FANOUT`` neighbouring ranges are hashed into the range above them, up to one root for each file and one over
all files and their names. A replica's files are those that lie in its folder and those of the index. Two replicas are the same if their roots are. If
not, the audit goes down only from ranges that differ, level by level, and ends at the damaged records.

Defined results: a null page body is empty; a null URL gives a record without target; line breaks in URLs are escaped;
null ids and repeated rows are records like others; a missing or cut file's ranges count as different; bytes after the last
record, and a file that only one replica has, are a range with the number after the last record's; files whose names start
with an underscore are unfinished and not looked at; an empty table
gives no files, equal roots and an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import byte_strings, filesystem, lean, shared_folder, written
from .packing import stored_type

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"


def record(url: str | None, body: bytes, number: int, date: str = DATE) -> bytes:
    """One gzip member with a resource record."""
    digest = hashlib.sha256(body).hexdigest()
    name = hashlib.sha256(f"{number} {url} {digest}".encode()).hexdigest()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes WARC files into ``folder``; the index (file, number, offset, length, id, n_bytes, payload_sha256) as a written table."""
    kind = pages.schema[id_col].dataType.simpleString()
    id_type = stored_type(pages, id_col)

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number, offset = context.partitionId(), 0, 0
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        own, name = f"{root}/_{part:06d}-{context.taskAttemptId()}", f"part-{part:06d}.warc.gz"
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                rows = []
                for i, url, body in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), byte_strings(batch, "body"), strict=True):
                    member = record(url, body, number)
                    out.write(member)
                    rows.append((name, number, offset, len(member), i, len(body), hashlib.sha256(body).hexdigest()))
                    number, offset = number + 1, offset + len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)
        if number:
            fs.move(own, f"{root}/{name}")
        else:
            fs.delete_file(own)

    names = ["file", "number", "offset", "length", "id", "n_bytes", "payload_sha256"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.string()]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    return written(rows.mapInArrow(lean(run), f"file string, number long, offset long, length long, id {kind}, n_bytes long, payload_sha256 string"))


def copy_files(index: DataFrame, source: str, target: str, damage: DataFrame | None = None) -> None:
    """Copies the archive's files, a task for each; ``damage`` (file, at) names bytes to flip on the way, for drills."""
    spots = index.select("file").distinct().withColumn("at", F.lit(None).cast("long"))
    if damage is not None:
        spots = spots.unionByName(damage.select("file", "at"))
    spots = spots.repartition("file").sortWithinPartitions("file", F.col("at").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = filesystem(source)
        to, goal = filesystem(target)
        to.create_dir(goal, recursive=True)
        name, flips, n = None, [], 0

        def copy():
            with fs.open_input_stream(f"{root}/{name}", compression=None) as i, to.open_output_stream(f"{goal}/_{attempt}-{name}", compression=None) as o:
                at = 0
                while chunk := bytearray(i.read(1 << 22)):
                    for k in flips:
                        if at <= k < at + len(chunk):
                            chunk[k - at] ^= 0xFF
                    o.write(bytes(chunk))
                    at += len(chunk)
            to.move(f"{goal}/_{attempt}-{name}", f"{goal}/{name}")

        for batch in batches:
            for f, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if f != name:
                    if name is not None:
                        copy()
                        n += 1
                    name, flips = f, []
                if at is not None:
                    flips.append(at)
        if name is not None:
            copy()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["copied"])

    spots.mapInArrow(lean(run), "copied long").agg(F.sum("copied")).collect()


def leaf(offset: int, stored: bytes) -> bytes:
    return hashlib.sha256(b"\0" + offset.to_bytes(8, "big") + len(stored).to_bytes(8, "big") + stored).digest()


def parent(start: int, end: int, children: list[bytes]) -> bytes:
    return hashlib.sha256(b"\1" + start.to_bytes(8, "big") + end.to_bytes(8, "big") + b"".join(children)).digest()


def tail(start: int, size: int, stream) -> bytes:
    """The leaf of a file's bytes from ``start`` to its end, read in pieces."""
    digest = hashlib.sha256(b"\0" + start.to_bytes(8, "big") + max(0, size - start).to_bytes(8, "big"))
    if size > start:
        stream.seek(start)
        while chunk := stream.read(1 << 22):
            digest.update(chunk)
    return digest.digest()


def files(folder: str) -> list[str]:
    """The names of a replica's files, with folders below it; a file for each writing task, so a short list."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = filesystem(folder)
    found = fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(x.path[len(root.rstrip("/")) + 1 :] for x in found if x.type == FileType.File and not x.base_name.startswith("_"))


def trees(index: DataFrame, folder: str) -> DataFrame:
    """(file, level, node, start, end, hash) of a replica, as a written table: level 0 are the records and the file's tail, the highest of a file is its root."""
    listed = index.sparkSession.createDataFrame([(f,) for f in files(folder)], "file string")
    other = listed.join(index.select("file").distinct(), "file", "left_anti").select("file", *[F.lit(None).cast("long").alias(c) for c in ("number", "offset", "length")])
    ordered = index.select("file", "number", "offset", "length").unionByName(other).repartition("file").sortWithinPartitions("file", "number")

    def run(batches):
        fs, root = filesystem(folder)
        name, stream, end = None, None, 0
        open_nodes: list[list] = []  # of every level, the children that wait for their parent
        counts: list[int] = []
        made: list[tuple] = []

        def put(level: int, start: int, end: int, digest: bytes) -> None:
            if level == len(counts):
                counts.append(0)
                open_nodes.append([])
            made.append((name, level, counts[level], start, end, digest))
            counts[level] += 1
            open_nodes[level].append((start, end, digest))
            if len(open_nodes[level]) == FANOUT:
                close(level)

        def close(level: int) -> None:
            kids = open_nodes[level]
            open_nodes[level] = []
            put(level + 1, kids[0][0], kids[-1][1], parent(kids[0][0], kids[-1][1], [k[2] for k in kids]))

        def finish() -> None:
            if name is None:
                return
            size = stream.size() if stream is not None else 0
            put(0, end, max(end, size), tail(end, size, stream))
            level = 0
            while level < len(counts) and (counts[level] > 1 or level + 1 < len(counts)):
                if open_nodes[level]:
                    close(level)
                level += 1

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 6, types, strict=True)], names=names)
            made.clear()
            return batch

        for batch in batches:
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if f != name:
                    finish()
                    counts, open_nodes = [], []
                    name, end = f, 0
                    try:
                        stream = fs.open_input_file(f"{root}/{f}")
                    except FileNotFoundError:
                        stream = None
                if offset is None:
                    continue
                stored = b""
                if stream is not None:
                    stream.seek(offset)
                    stored = stream.read(length)
                end = offset + length
                put(0, offset, end, leaf(offset, stored))
            yield out()
        finish()
        yield out()

    names = ["file", "level", "node", "start", "end", "hash"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return written(ordered.mapInArrow(lean(run), "file string, level int, node long, start long, end long, hash binary"))


def roots(tree: DataFrame) -> DataFrame:
    """(file, level, hash): the root of every file."""
    return tree.groupBy("file").agg(F.max("level").alias("level")).join(tree.select("file", "level", "node", "hash"), ["file", "level"]).where("node = 0").select("file", "level", "hash")


def archive_root(tree: DataFrame) -> str | None:
    """One hash over all files' roots in the order of their names, by two layers of groups."""
    r = roots(tree).select("file", F.hex("hash").alias("hash"))
    groups = r.groupBy(F.regexp_extract("file", r"(\d+)\d{3}\.", 1).alias("group")).agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("file", "hash"))), lambda x: F.concat(x["file"], F.lit(" "), x["hash"], F.lit("\n")))), 256).alias("hash"))
    rows = groups.orderBy("group").collect()  # a row for every thousand files
    return hashlib.sha256("".join(x["hash"] for x in rows).encode()).hexdigest() if rows else None


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """(file, number, start, end) of the records, and of other bytes and files, in which two replicas' trees differ."""
    keys = ["file", "level", "node"]
    both = one.select(*keys, "start", "end", F.col("hash").alias("h1"))
    other = two.select(*keys, F.col("end").alias("end2"), F.col("hash").alias("h2"))
    if archive_root(one) == archive_root(two):
        return both.where(F.lit(False)).select("file", F.col("node").alias("number"), "start", "end")
    tops = roots(one).select("file", "level")
    added = two.where("level = 0").join(tops.select("file"), "file", "left_anti").select("file", "node", "start", "end")
    height = one.agg(F.max("level").alias("n")).collect()[0]["n"]
    suspects = None
    for level in range(-1 if height is None else height, -1, -1):
        nodes = both.where(F.col("level") == level)
        look = tops.where(F.col("level") == level).select("file", F.lit(0).cast("long").alias("node"))
        if suspects is not None:
            below = suspects.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            look = look.unionByName(below)
        nodes = nodes.join(look, ["file", "node"]).join(other.where(F.col("level") == level).drop("level"), ["file", "node"], "left")
        suspects = written(nodes.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "node", "start", F.greatest("end", "end2").alias("end")))
    return (added if suspects is None else suspects.unionByName(added)).withColumnRenamed("node", "number")


def drill(pages: DataFrame, damaged, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, n_bytes, payload_sha256, intact) of every page: an archive and a replica with one byte flipped in each record of ``damaged`` (a condition on the id), audited."""
    spark: SparkSession = pages.sparkSession
    folder = shared_folder(spark)
    index = write_archive(pages, f"{folder}/one", id_col, url_col, body_col)
    spots = index.withColumnRenamed("id", id_col).where(damaged).select("file", (F.col("offset") + F.col("length") / 2).cast("long").alias("at"))
    copy_files(index, f"{folder}/one", f"{folder}/two", spots)
    found = audit(trees(index, f"{folder}/one"), trees(index, f"{folder}/two")).select("file", "number", F.lit(False).alias("intact"))
    return index.join(found, ["file", "number"], "left").select(F.col("id").alias(id_col), "n_bytes", "payload_sha256", F.coalesce("intact", F.lit(True)).alias("intact"))
