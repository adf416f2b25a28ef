"""Near-duplicate documents by SetSketch registers (operator 6).

A document is the set of its five-word shingles. Register i of its sketch is 1 - log_b of the least of the set's
exponential variates under hash i, rounded down and cut to 16 bits: mergeable, and alike in similar sets. Bands of four
registers are buckets. The steps, each a written table:

1. ``sketches``: id, set size, fingerprint of the word sequence, registers. Equal fingerprints are one class; only a
   class's smallest id goes on, so copies cost nothing further.
2. Every document meets the smallest id of the bucket it shares most buckets with; verified meetings are a forest.
3. Buckets that still hold several components are gone through in blocks of at most ``BLOCK`` by ``BLOCK`` sketches.
   For pairs across components the joint likelihood of the registers tells which similarities are plausible. Twice the
   likeliest partner of each document is verified, then every plausible pair that is left.
   Where large groups meet, sets are looked up in files and pairs are verified where they are found.
4. Links are confirmed on full shingle sets. Components are followed by hooking to smaller ids and pointer jumping.

Pairs inside a component are never verified, so a large group costs about a link for each document, and no pair that
could join two components is left out. With 32 bands of 4 a pair at similarity 0.75 shares no bucket with a chance of
5 in a million; pairs above it have less.

Defined results: a text without words has an empty set and is linked with nothing; null texts count as empty; a null id
is linked with nothing and stays; rows that share an id are one document; an empty table gives an empty result; columns
other than those named are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_strings, dropped, filesystem, fresh, lean, salted, shared_folder, written
from .packing import stored_type
from .sstable import Shard, ShardWriter, key_of

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_535
BLOCK = 512
IN_PLACE = 256
#: An id in more pairs than this is verified by several tasks.
HOT = 500
#: About so many pairs of sketches are compared by a task, so tasks stay alike when the input grows.
TASK_PAIRS = 4_000_000
#: Bytes of shingle sets in a bucket, about.
SET_BYTES = 64 << 20
#: A pair is dropped on its registers only if they are e**9 times likelier at another similarity than at the threshold.
SLACK = 9.0

_random = np.random.default_rng(20_240_607)
_MULTIPLIERS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a word sequence's shingles; one for the whole of a shorter sequence."""
    import xxhash

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    s = h[: n - size + 1].copy()
    for k in range(1, size):
        s *= _STEP
        s += h[k : n - size + 1 + k]
    return np.unique(s)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; an empty set's registers are 0."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    x = hashes ^ (hashes >> np.uint64(31))
    x = ((x * _MIX) >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(least, (x[k : k + 256, None] * _MULTIPLIERS + _ADDENDS).min(axis=0), out=least)
    variates = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variates) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 201)


def likelihoods(larger: np.ndarray, smaller: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, how much likelier, as a logarithm, than the least similarity of a link or more).

    ``larger`` and ``smaller`` count the registers in which the first or the second sketch has the greater value; n1 and
    n2 are the sets' sizes. The rest of the registers are equal.
    """
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = share(u - v * j), share(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    equal = (REGISTERS - larger - smaller)[:, None]
    total = larger[:, None] * log(p) + smaller[:, None] * log(q) + equal * log(1 - p - q)
    best = total.argmax(axis=1)
    linked = np.where(_GRID[None, :] >= 0.745, total, -np.inf).max(axis=1)
    return j[np.arange(len(best)), best], total.max(axis=1) - linked


def plausible(larger, smaller, n1, n2) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, whether a link can't be excluded)."""
    best, lead = likelihoods(larger, smaller, n1, n2)
    return best, (lead <= SLACK) & (np.minimum(n1, n2) * 100 >= 75 * np.maximum(n1, n2))


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: A-Z only, ASCII white space only


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, f1, f2, registers) of every document."""

    def run(batches):
        import xxhash

        for batch in batches:
            n, f1, f2, regs = [], [], [], []
            for raw in byte_strings(batch, "text"):
                words = _words(raw)
                s = shingle_set(words)
                f = xxhash.xxh3_128_digest(b" ".join(words))
                n.append(len(s))
                f1.append(int.from_bytes(f[:8], "little", signed=True))
                f2.append(int.from_bytes(f[8:], "little", signed=True))
                regs.append(registers(s).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary())], names=["id", "n", "f1", "f2", "registers"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, n long, f1 long, f2 long, registers binary")


def bucket_of(column: str, files: int) -> Column:
    """The bucket, and so the shard, of an id: that of Spark's own bucketing and hash partitioning."""
    return F.pmod(F.hash(column), F.lit(files)).cast("int")


class SetFiles:
    """Shingle sets in sorted-string-table shards of the shared folder, for looking up single sets from a task.

    A task holds at most ``OPEN`` shards' sparse indexes and filters, and ``CACHE_BYTES`` of sets.
    """

    CACHE_BYTES, OPEN, BLOCK_BYTES = 64 << 20, 32, 1 << 14

    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, files
        self.open: dict = {}
        self.sets: dict = {}
        self.held = 0

    def get(self, i, bucket: int) -> np.ndarray:
        if i in self.sets:
            return self.sets[i]
        shard = self.open.pop(bucket, None) or Shard(f"{self.folder}/{bucket}")
        self.open[bucket] = shard  # the last in order is the one used last
        if len(self.open) > self.OPEN:
            self.open.pop(next(iter(self.open))).close()
        got = shard.get(i)[0]
        if self.held > self.CACHE_BYTES:
            self.sets.clear()
            self.held = 0
        self.sets[i] = got
        self.held += got.nbytes
        return got


def shingle_sets(docs: DataFrame, wanted: DataFrame, files: int) -> tuple[DataFrame, SetFiles]:
    """(id, n, hashes: eight bytes for each shingle, ascending) of the ``wanted`` (id) among ``docs`` (id, text).

    Texts are shuffled once, by id. The sets are stored as a table in ``files`` buckets by id, which joins by id read
    without shuffling them again, and each bucket as a shard for lookups beside it. A task has to hold one bucket, so the
    wanted ids travel as rows before their texts: a join may be planned with another number of partitions.
    """
    spark = docs.sparkSession
    folder, stem = shared_folder(spark), f"shingle_sets_{uuid.uuid4().hex}"
    kind = docs.schema["id"].dataType.simpleString()
    stored = stored_type(docs, "id")

    def run(batches):
        from pyspark import TaskContext

        fs, root = filesystem(f"{folder}/shards")
        fs.create_dir(root, recursive=True)
        own, bucket, last, named = f"{root}/_{TaskContext.get().taskAttemptId()}", None, None, None
        with fs.open_output_stream(own, compression=None) as out:
            w = ShardWriter(out, 8, SetFiles.BLOCK_BYTES)
            for batch in batches:
                texts = byte_strings(batch, "text")
                buckets, all_ids, names = (batch.column(c).to_pylist() for c in ("bucket", "id", "name"))
                for k in range(0, len(texts), 256):
                    ids, sets = [], []
                    for b, i, t, name in zip(buckets[k : k + 256], all_ids[k : k + 256], texts[k : k + 256], names[k : k + 256], strict=True):
                        if name:
                            named = i
                            continue
                        if i is None or i != named or i == last:
                            continue  # rows that share an id are one document
                        if bucket not in (None, b):
                            raise ValueError("a task holds ids of several buckets")
                        bucket, last = b, i
                        ids.append(i)
                        sets.append(shingle_set(_words(t)).astype("<u8").tobytes())
                        w.add(key_of(i), sets[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, stored), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["id", "n", "hashes"])
            w.close()
        if bucket is None:
            fs.delete_file(own)
        else:
            fs.move(own, f"{root}/{bucket}")

    rows = docs.select("id", "text", F.lit(False).alias("name")).unionByName(wanted.select("id", F.lit(None).cast(docs.schema["text"].dataType).alias("text"), F.lit(True).alias("name")))
    rows = rows.repartition(files, "id").withColumn("bucket", bucket_of("id", files)).sortWithinPartitions("id", F.desc("name"), "text")
    rows.select("id", "bucket", "text", "name").mapInArrow(lean(run), f"id {kind}, n long, hashes binary").write.bucketBy(files, "id").sortBy("id").option("path", f"{folder}/table").saveAsTable(stem)
    sets = spark.table(stem)
    sets._folder, sets._name = folder, stem
    return sets, SetFiles(f"{folder}/shards", files)


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets have 3/4 of their union in common."""
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= 75 * (len(s) + len(t) - common)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, band, rep) for every band of every class."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("registers", j * width + 1, width)) for j in range(BANDS)])
    return classes.select("rep", F.posexplode(keys).alias("band", "key"))


def with_sets(pairs: DataFrame, sets: DataFrame, column: str, other: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the size n_<column> and hashes h_<column> of the set that ``column`` names.

    ``hot`` (id, salts) are ids in very many pairs, such as the smallest id of a large group. Their pairs are dealt to as
    many tasks as ``salts`` says, and only their own sets are repeated as often. The others meet the sets bucket by bucket.
    """
    named = lambda s: s.select(F.col("id").alias(column), F.col("n").alias(f"n_{column}"), F.col("hashes").alias(f"h_{column}"), *[c for c in s.columns if c == "salt"])
    known = hot.select(F.col("id").alias(column), "salts")
    cold = salted(pairs, known, [column], F.col(other), "left_anti").join(named(sets), column)
    few = named(sets.join(hot, "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    dealt = salted(pairs, known, [column], F.col(other)).withColumn("salt", F.pmod(F.xxhash64(F.lit(1), other), "salts").cast("int")).drop("salts")
    return cold.unionByName(dealt.join(few, [column, "salt"]).drop("salt"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs``, a written table, whose full sets have 3/4 of their union in common; a written table."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True):
                keep.append(linked(*(np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # at most 1 / HOT of the pairs' ids are hot
    hot = {c: pairs.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("id", F.ceil(F.col("c") / HOT).cast("int").alias("salts")) for c in "ab"}
    for c in "ab":
        table = written(hot[c])
        hot[c] = table if table.limit(1).count() else None
    both = pairs
    for c, other in ("ab", "ba"):
        if hot[c] is not None:
            both = with_sets(both, sets, c, other, hot[c])
        else:
            both = both.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")), c)
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * 75
    out = written(both.where(near).select("a", "b", "h_a", "h_b").mapInArrow(lean(run), f"a {kind}, b {kind}").distinct())
    dropped(*[t for t in hot.values() if t is not None])
    return out


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) with every parent smaller than its node: pointer jumping, logarithmic in the depth.

    Of a hot parent's rows only ids travel; adaptive execution splits them.
    """
    table = written(parents)
    while True:
        up = table.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = written(table.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        dropped(table)
        table = jumped
        if not table.where("moved").limit(1).count():
            out = table.select("node", F.col("parent").alias("root"))
            out._folder = table._folder
            return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root), a written table that goes, after joining the components that ``links`` (a, b) connect."""
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    edges = written(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    while edges.limit(1).count():
        roots = _roots(edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("parent")))
        new = roots.select(F.col("node").alias("old"), F.col("root").alias("new"))
        known = labels.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        added = roots.join(labels.select("node"), "node", "left_anti")
        old, labels = labels, written(known.unionByName(added))
        left = edges.join(new.select(F.col("old").alias("x"), F.col("new").alias("nx")), "x", "left").join(new.select(F.col("old").alias("y"), F.col("new").alias("ny")), "y", "left").select(F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))
        left = written(left.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        dropped(old, edges, roots)
        edges = left
    dropped(edges)
    return labels


def across(members: DataFrame, labels: DataFrame, classes: DataFrame, files: SetFiles, best_only: bool) -> DataFrame:
    """Plausible pairs (a, b) of different components that share a bucket.

    ``members``: (key, band, rep) of the buckets with several classes. In a bucket only the documents outside its
    largest component (the rest) have to be compared, with everything in it. So the bucket is cut into parts of at most
    ``BLOCK`` documents on one side and its rest likewise on the other, and a task goes over one part of each at a time.

    With ``best_only`` each document of the rest gives its likeliest partner in each part: as many pairs as there are
    rows. Without it all plausible pairs come out, each in the first bucket that the two share. Where two parts have
    more than ``IN_PLACE`` of them, their sets are looked up there and then, and only a link comes out for each document
    and component.
    """
    rows = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top"))
    part = lambda n: ((n - 1) / BLOCK).cast("int")
    mixed = written(counts.where("size > most").select("key", "top", "size", (F.col("size") - F.col("most")).alias("others")))
    work = mixed.agg(F.sum(F.col("size").cast("double") * F.col("others"))).collect()[0][0] or 0.0
    tasks = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work // TASK_PAIRS))
    mixed = mixed.select("key", "top", part(F.col("size")).alias("last"), part(F.col("others")).alias("rest_last"))
    rows = salted(rows, mixed, ["key"], F.col("rep")).join(classes.select("rep", "n", "registers"), "rep")
    own, rest_own = (F.pmod(F.xxhash64("rep", F.lit(k)), F.col(c) + 1).cast("int") for k, c in enumerate(("last", "rest_last")))
    spot = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    rest = F.col("root") != F.col("top")
    here = F.transform(F.sequence(F.lit(0), F.col("rest_last")), lambda j: spot(own, j, False))
    there = F.when(rest, F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: spot(i, rest_own, True))).otherwise(F.array().cast("array<struct<i:int,j:int,right:boolean>>"))
    blocks = rows.select("key", "band", "rep", "root", rest.alias("rest"), "n", "registers", bucket_of("rep", files.files).alias("bucket"), F.explode(F.concat(here, there)).alias("s"))
    blocks = blocks.select("key", F.col("s.i").alias("i"), F.col("s.j").alias("j"), F.col("s.right").alias("right"), "band", "rep", "root", "rest", "n", "registers", "bucket").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    kind = classes.schema["rep"].dataType.simpleString()
    stored = stored_type(classes, "rep")

    def pairs_of(held: list, out: set) -> None:
        right = np.array([h[0] for h in held])
        if right.all() or not right.any():
            return
        band = held[0][1]
        ids, found = [h[2] for h in held], []
        rep, root, rest, n = (np.array([h[k] for h in held]) for k in (2, 3, 4, 5))
        regs = np.stack([np.frombuffer(h[6], "<u2") for h in held])
        left = np.flatnonzero(~right)
        for i in np.flatnonzero(right):
            js = left[root[left] != root[i]]
            if not best_only:
                js = js[~rest[js] | (rep[js] < rep[i])]
            js = js[np.minimum(n[js], n[i]) * 100 >= 75 * np.maximum(n[js], n[i])]
            if not len(js):
                continue
            x, y = regs[js], regs[i]
            same = (x == y).reshape(len(js), BANDS, ROWS)
            if not best_only:
                first = same.all(axis=2).argmax(axis=1) == band
                js, x = js[first], x[first]
                if not len(js):
                    continue
            smaller = (x > y).sum(axis=1)
            larger = (x < y).sum(axis=1)
            best, keep = plausible(larger, smaller, np.full(len(js), n[i]), n[js])
            if keep.any():
                found.append((i, js[keep][np.argsort(-best[keep], kind="stable")]))
        in_place = not best_only and sum(len(js) for _, js in found) > IN_PLACE
        for i, js in found:
            met = set()
            for j in js[:1] if best_only else js:
                if in_place:
                    if root[j] in met or not linked(files.get(ids[i], held[i][7]), files.get(ids[j], held[j][7])):
                        continue
                    met.add(root[j])
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))

    def run(batches):
        held: list = []
        key = None
        out: set = set()

        def batch_of():
            pairs = sorted(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], stored) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            d = batch.to_pydict()
            for k, i, j, *row in zip(*(d[c] for c in ("key", "i", "j", "right", "band", "rep", "root", "rest", "n", "registers", "bucket")), strict=True):
                if (k, i, j) != key:
                    if held:
                        pairs_of(held, out)
                        held.clear()
                    key = (k, i, j)
                held.append(row)
            if len(out) > 10_000:
                yield batch_of()
        if held:
            pairs_of(held, out)
        yield batch_of()

    return blocks.mapInArrow(lean(run), f"a {kind}, b {kind}").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    table = written(sketches(docs, id_col, text_col))
    full = table.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(full.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")))

    bands = band_keys(classes)
    buckets = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("key", "hub")
    met = written(salted(bands, buckets, ["key"], F.col("rep")))
    members = met.select("key", "band", "rep")
    wanted = met.groupBy("rep").agg(F.count(F.lit(1)).alias("buckets")).select(F.col("rep").alias("id"))
    size = 8 * (classes.agg(F.sum("n")).collect()[0][0] or 0)
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SET_BYTES))
    sets, lookup = shingle_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, files)

    common = met.where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("buckets"))
    star = written(common.groupBy(F.col("rep").alias("a")).agg(F.max_by("hub", F.struct("buckets", "hub")).alias("b")))
    links = verified(star, sets)
    labels = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
    dropped(star, links)
    for best_only in (True, True, False):
        pairs = written(across(members, labels, classes, lookup, best_only))
        links = verified(pairs, sets)
        labels = joined(labels, links)
        dropped(pairs, links)
    dropped(met, sets)
    docs.sparkSession.sql(f"DROP TABLE {sets._name}")

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or root is not null").select("f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    rows = table.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("f1")).alias("f1"), "f2")
    out = salted(rows, named, ["f1", "f2"], F.col("id"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each component, with their columns as they were."""
    name = fresh("_id", docs.columns)
    out = components(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(out, F.col(id_col) == F.col(name), "left_anti")
