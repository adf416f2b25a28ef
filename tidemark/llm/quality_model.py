"""Histogram gradient-boosted trees over document statistics (operator 5).

The statistics are made from whole texts alone. The trees grow on the driver, from at most ``max_rows`` labelled rows
(those with the smallest hash of their id, so the choice does not depend on the layout); the fitted trees are flat
arrays that numpy walks for a whole batch at once.

Defined results: a null text is empty and has a score like any other; a null id is never labelled; of several labels of
one id the mean counts; without labels of both kinds every score is the share of label 1 (0.5 without labels); an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_strings, lean

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "exclaims", "symbols", "bars", "high_bytes", "spaces", "log_lines", "words_per_line", "repeated_lines", "distinct_words", "commonest_length", "shouted_words", "lone_words", "ends_in_stop", "deflated", "sentences", "control", "longest_word")

_MARKS = np.frombuffer(b".,;:?'\"()-", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=+\\/{}[]", np.uint8)


def statistics(raw: bytes) -> list[float]:
    """The features of one text in UTF-8; shares are of its bytes, words or lines."""
    n = max(len(raw), 1)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    w, k = max(len(words), 1), max(len(lines), 1)
    distinct = set(words)
    counts = np.bincount(np.fromiter(map(len, words), np.int64, len(words)), minlength=1) if words else np.zeros(1)
    shouted = sum(x.isupper() for x in distinct)
    bare = int(c[9:14].sum() + c[32])
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - bare) / w, c[65:91].sum() / n, c[48:58].sum() / n, c[_MARKS].sum() / n, c[33] / w, c[_SYMBOLS].sum() / n, c[124] / w, c[128:].sum() / n, bare / n,
        np.log1p(len(lines)), w / k, 1 - len(set(lines)) / k, len(distinct) / w, counts.max() / w, shouted / max(len(distinct), 1), counts[1] / w if len(counts) > 1 else 0.0, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / k,
        len(zlib.compress(raw, 1)) / n, c[46] / w, (c[:9].sum() + c[14:32].sum() + c[127]) / n, np.log1p(len(counts) - 1),
    ]


def feature_rows(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Complete trees of one depth as arrays [tree, node]; node k's children are 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return total
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return total + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosting on the logistic loss; splits come from histograms of gradients over quantile bins."""
    y = np.asarray(y, np.float64)
    inner, leaves = 2**depth - 1, 2**depth
    p = y.mean() if len(y) else 0.5
    p = min(max(p, 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), depth)
    if len(y) < 2 * least or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    feats, cuts, values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feat, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best_gain, best_f, best_b = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            gt, ht = np.bincount(local, g, width), np.bincount(local, h, width)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                at, size = local * bins + binned[:, f], width * bins
                gl, hl, nl = (np.bincount(at, v, size).reshape(width, bins).cumsum(1)[:, :-1] for v in (g, h, None))
                n = nl[:, -1:] + np.bincount(at, None, size).reshape(width, bins)[:, -1:]
                gain = gl**2 / (hl + l2) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + l2) - (gt**2 / (ht + l2))[:, None]
                gain[(nl < least) | (n - nl < least)] = -1
                gain[:, len(edges[f]) :] = -1
                b = gain.argmax(1)
                better = gain[np.arange(width), b] > best_gain
                best_gain[better], best_f[better], best_b[better] = gain[np.arange(width), b][better], f, b[better]
            for k in np.flatnonzero(best_f >= 0):
                feat[first + k], cut[first + k] = best_f[k], edges[best_f[k]][best_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feat[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[leaf]
        feats.append(feat)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(feats), np.array(cuts), np.array(values), depth)


def held_out(id_col: str):
    """Whether a row is never learned from: crc32 of its id as text is a multiple of 5. A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Trees:
    """Trees fitted to at most ``max_rows`` labelled documents that are not held out."""
    mean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_key")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = mean.orderBy(*order).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_key")

    def run(batches):
        for batch in batches:
            x = feature_rows(byte_strings(batch, "_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["_key", "_label", "_x"])

    made = rows.mapInArrow(lean(run), f"_key {mean.schema['_key'].dataType.simpleString()}, _label double, _x array<double>").orderBy(*order, "_x").limit(max_rows).collect()
    x = np.array([r["_x"] for r in made], np.float64).reshape(len(made), len(FEATURES))
    return fit(x, np.array([float(r["_label"] >= 0.5) for r in made]))


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", columns: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The named columns (all, if none are named) of every row and its score."""
    columns = docs.columns if columns is None else columns
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # a few hundred KB at most
    picked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], F.col(text_col).cast("binary").alias("_text"))

    def run(batches):
        for batch in batches:
            x = feature_rows(byte_strings(batch, "_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(columns))), pa.array(shared.value.scores(x))], names=[*(f"_{i}" for i in range(len(columns))), "_score"])

    schema = T.StructType([*(T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(columns)), T.StructField("_score", T.DoubleType())])
    return picked.mapInArrow(lean(run), schema).toDF(*columns, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    rows = scored(docs, learn(docs, labels, id_col, text_col), text_col, [id_col])
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns as they were."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, trees, text_col, score_col=name).where(F.col(name) >= threshold).drop(name)
