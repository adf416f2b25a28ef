"""Exact BM25 top-k search (operator 10): inverted shards, block-max pruning, an exact merge.

Documents are indexed in shards of bounded size, each a file in the shared folder with terms and postings (document,
count); block maxima are made when it is read, as they depend on the average length. Document frequencies, lengths and
the number of documents are summed over all shards, so a score does not depend on the shard.

A query goes over a shard from rare terms to common ones. The rare and the common terms' impacts are added up first. What
the commonest terms can add at most is known for every block of documents from the blocks' maxima, and a document stays
in the race only if its score so far and its block's bound reach the k-th best score; the commonest terms' lists are
looked up for those alone. The k-th best score starts from one shard that is searched first, by a task for every file of
queries, so the other shards prune from their first query on and return little. Then a task takes up to ``FILES`` files of
queries through one shard, so no task grows with the corpus.

score(q, d) = sum over the distinct terms of q of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * |d| / avg))

Terms are words of bytes other than ASCII white space, A-Z lower-cased. Scores are rounded to six digits, so the order
of a sum doesn't show, and ties go to the smaller id.

Defined results: null texts are empty; an empty query finds nothing; only documents that share a term with the query are
found; null ids are neither searched for nor found, and ids are cast to long, so others than numbers fail or count as null;
repeated rows are found once each; an empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_strings, filesystem, lean, shared_folder, written

K1, B = 1.2, 0.75
BLOCK = 64
#: A term in more than 1 / COMMON of a shard's documents has a dense row, one in more than 1 / COMMONEST block maxima.
COMMON, COMMONEST = 16, 4
#: A shard is closed at this many postings or documents. Its dense rows take at most 8 * COMMON bytes for each posting.
SHARD_POSTINGS, SHARD_DOCS = 3_000_000, 20_000
#: Queries of a file, and files that a task takes through its shard after reading it once.
QUERIES, FILES = 512, 16
#: With more tasks than this a task takes more files, as the driver lists them.
MOST_TASKS = 100_000


def terms_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def term_hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term) >> 1  # fits a signed long


class Builder:
    """One shard in memory."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.terms, self.counts = [], [], [], [], []
        self.postings = 0

    def add(self, doc_id: int, raw: bytes) -> None:
        words = terms_of(raw)
        counted = Counter(words)
        self.docs.append(np.full(len(counted), len(self.ids), np.int32))
        self.terms.append(np.fromiter(map(term_hash, counted), np.int64, len(counted)))
        self.counts.append(np.fromiter(counted.values(), np.int32, len(counted)))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.postings += len(counted)

    def arrays(self) -> dict[str, np.ndarray]:
        docs, terms, counts = np.concatenate(self.docs), np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        names, starts = np.unique(terms, return_index=True)
        return {"ids": np.array(self.ids, np.int64), "lengths": np.array(self.lengths, np.int32), "terms": names, "starts": np.append(starts, len(terms)).astype(np.int64), "docs": docs[order], "counts": counts[order]}


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = uuid.uuid4().hex  # only files that a finished task has named are ever read
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(raw.getbuffer())
    return f"{folder}/{name}"


def build(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Writes the shards; (shard, term, df, docs, length) as a written table, with a null term for a shard's totals."""

    def rows(builder: Builder):
        a = builder.arrays()
        path = save(folder, a)
        n, df = len(a["terms"]), np.diff(a["starts"])
        for k in range(0, n, 200_000):
            m = min(200_000, n - k)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.array(a["terms"][k : k + m]), pa.array(df[k : k + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([path], pa.string()), ([None], pa.int64()), ([None], pa.int64()), ([len(a["ids"])], pa.int64()), ([int(a["lengths"].sum())], pa.int64()))], names=names)

    def run(batches):
        b = Builder()
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), byte_strings(batch, "text"), strict=True):
                b.add(i, raw)
                if b.postings >= SHARD_POSTINGS or len(b.ids) >= SHARD_DOCS:
                    yield from rows(b)
                    b = Builder()
        if b.ids:
            yield from rows(b)

    names = ["shard", "term", "df", "docs", "length"]
    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(picked.mapInArrow(lean(run), "shard string, term long, df long, docs long, length long"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term) of distinct terms."""

    def run(batches):
        for batch in batches:
            ids, ts = [], []
            for i, raw in zip(batch.column("id").to_pylist(), byte_strings(batch, "text"), strict=True):
                t = sorted({term_hash(x) for x in set(terms_of(raw))})
                ids += [i] * len(t)
                ts += t
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ts, pa.int64())], names=["query", "term"])

    picked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lean(run), "query long, term long")


class Shard:
    """A shard read for searching. Its terms are of three kinds by their share of the documents: rare ones are posting
    lists, common ones rows of a dense matrix, and the commonest are rows too, with the blocks' maxima beside them."""

    def __init__(self, uri: str, average: float):
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            raw = io.BytesIO(f.read())
        with np.load(raw) as z:
            self.ids, lengths, self.terms, self.starts, self.docs, counts = (z[k] for k in ("ids", "lengths", "terms", "starts", "docs", "counts"))
        norm = K1 * (1 - B + B * lengths / max(average, 1e-9))
        self.impacts = counts * (K1 + 1) / (counts + norm[self.docs])
        n, df = len(self.ids), np.diff(self.starts)
        self.row = np.full(len(self.terms), -1)
        self.dense = []
        for at in (np.flatnonzero((df * COMMON > n) & (df * COMMONEST <= n)), np.flatnonzero(df * COMMONEST > n)):
            rows = np.zeros((len(at), n))
            for k, t in enumerate(at):
                lo, hi = self.starts[t], self.starts[t + 1]
                rows[k, self.docs[lo:hi]] = self.impacts[lo:hi]
            self.row[at] = np.arange(len(at))
            self.dense.append(rows)
        self.kind = (df * COMMON > n).astype(int) + (df * COMMONEST > n)
        edges = np.arange(0, n, BLOCK)
        self.block_max = np.maximum.reduceat(self.dense[1], edges, axis=1) if n else np.zeros((0, 0))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[int, float]]]:
        """For each query (terms, idf, floor) the k best (id, score) with a score of at least its floor."""
        n, found = len(self.ids), []
        weights = np.zeros((2, len(queries), max(len(d) for d in self.dense)))
        rare = []
        for q, (terms, idf, _) in enumerate(queries):
            at = np.searchsorted(self.terms, terms)
            here = at < len(self.terms)
            here[here] = self.terms[at[here]] == terms[here]
            at, idf = at[here], idf[here]
            kind = self.kind[at]
            for level in (1, 2):
                weights[level - 1, q, self.row[at[kind == level]]] = idf[kind == level]
            rare.append((at[kind == 0], idf[kind == 0]))
        common = weights[0, :, : len(self.dense[0])] @ self.dense[0]
        top = weights[1, :, : len(self.dense[1])]
        bounds = top @ self.block_max
        for q, (at, idf) in enumerate(rare):
            score = common[q]
            if len(at):
                lo = self.starts[at]
                size = self.starts[at + 1] - lo
                i = np.repeat(lo - np.append(0, size.cumsum()[:-1]), size) + np.arange(size.sum())
                score = score + np.bincount(self.docs[i], self.impacts[i] * np.repeat(idf, size), n)
            floor = queries[q][2]
            if k <= n:  # what the k-th best document has already bounds the final k-th best
                floor = max(floor, np.partition(score, n - k)[n - k])
            floor -= 1e-6
            race = np.flatnonzero(score + np.repeat(bounds[q], BLOCK)[:n] >= floor)
            # only the documents in the race are looked up in the commonest terms' lists
            value = np.round(score[race] + top[q] @ self.dense[1][:, race], 6)
            keep = (value > 0) & (value >= floor)
            race, value = race[keep], value[keep]
            best = np.lexsort((self.ids[race], -value))[:k]
            found.append(list(zip(self.ids[race[best]].tolist(), value[best].tolist(), strict=True)))
        return found


def _blocks(folder: str, names: list[str]):
    """The queries (query, terms, idf, floor) in files of a written table, one row group after another."""
    import pyarrow.parquet as pq

    fs, root = filesystem(folder)
    for name in names:
        with fs.open_input_file(f"{root}/{name}") as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=256)


def _files(folder: str) -> list[str]:
    """The Parquet files of a written table: one for ``QUERIES`` queries."""
    from pyarrow.fs import FileSelector

    fs, root = filesystem(folder)
    return sorted(x.base_name for x in fs.get_file_info(FileSelector(root)) if x.base_name.endswith(".parquet"))


def _searched(spark, shards: list[str], average: float, folder: str, tasks: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(query, id, score): the k best of every query in each shard; a task for each (shard, files of queries)."""

    def run(batches):
        for batch in batches:
            for path, names in zip(batch.column("path").to_pylist(), batch.column("names").to_pylist(), strict=True):
                shard = Shard(path, average)
                for block in _blocks(folder, names):
                    qs, ds, ss = [], [], []
                    asked = [(t.values.to_numpy(), w.values.to_numpy(), low.as_py()) for t, w, low in zip(*(block.column(c) for c in ("terms", "idf", "floor")), strict=True)]
                    for q, found in zip(block.column("query").to_pylist(), shard.search(asked, k), strict=True):
                        for d, s in found:
                            qs.append(q)
                            ds.append(d)
                            ss.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(ds, pa.int64()), pa.array(ss, pa.float64())], names=["query", "id", "score"])

    rows = spark.createDataFrame([(i, shards[n], names) for i, (n, names) in enumerate(tasks)], "task int, path string, names array<string>")
    return rows.repartitionById(max(1, len(tasks)), "task").mapInArrow(lean(run), "query long, id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k best documents of every query, over all documents."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    table = build(docs, f"{folder}/shards", id_col, text_col)
    totals = table.where(F.col("shard").isNotNull()).select("shard", "docs", "length").orderBy(F.desc("docs"), "shard").collect()  # a row for each shard
    n = sum(r["docs"] for r in totals)
    average = sum(r["length"] for r in totals) / max(n, 1)
    shards = [r["shard"] for r in totals]

    asked = written(query_terms(queries, id_col, text_col).distinct())
    df = table.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    weighted = asked.join(df, "term").withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    lists = weighted.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("idf", "term")), asc=False).alias("x")).select("query", F.col("x.term").alias("terms"), F.col("x.idf").alias("idf"))
    files = -(-queries.where(F.col(id_col).isNotNull()).count() // QUERIES)
    plain = written(lists.withColumn("floor", F.lit(0.0)).repartition(max(1, files), "query"), f"{folder}/queries")
    if not shards:
        return plain.select(F.col("query").alias("query_id"), F.lit(1).alias("rank"), F.col("query").alias(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    first = written(_searched(spark, shards, average, f"{folder}/queries", [(0, [name]) for name in _files(f"{folder}/queries")], k))
    floors = first.groupBy(F.col("query").alias("q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("low"))
    primed = plain.join(floors, F.col("query") == F.col("q"), "left").select("query", "terms", "idf", F.coalesce("low", "floor").alias("floor"))
    written(primed.repartition(max(1, files), "query"), f"{folder}/primed")
    names = _files(f"{folder}/primed")
    take = max(FILES, -(-len(names) * len(shards) // MOST_TASKS))
    tasks = [(s, names[i : i + take]) for s in range(1, len(shards)) for i in range(0, len(names), take)]
    found = first.unionByName(_searched(spark, shards, average, f"{folder}/primed", tasks, k)) if tasks else first
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
