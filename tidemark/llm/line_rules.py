"""Quality rules with cross-document line frequency (operator 4), in DataFrame functions only.

Every document gets its base figures. Its lines, lower-cased and with single spaces, are hashed; for each host and line
the distinct documents are counted, and a line in more than ``max_documents`` of them is boilerplate. What is left of a
document after its boilerplate lines go decides whether it stays: with less than ``min_share`` of its words, or fewer than
``min_words``, it is depleted.

Copies of one document are not different documents: those with the same lines in the same order, but for case and spaces,
count as one. So a text that was copied a thousand times is not taken for boilerplate, and a template's lines are.

Counts are grouped after partial sums, so a line or host that is everywhere loads no single task; the join of lines with
boilerplate ones is salted, as a boilerplate line is a hot key by its nature.

Defined results: a null text has no words; documents without a word or line fail the base rules; a null host is a host;
null ids and repeated rows come out as they went in; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, salted, written

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def line_hash(line: Column) -> Column:
    """The first 60 bits of md5, which SQL engines share."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def plain(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, _SPACE, " "), F.lit(" ")))


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", window: int = 8) -> DataFrame:
    """(row, id, host, print, base figures, lines) of every document; lines: (hash, words), one for each line with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    d = d.select("id", "host", F.xxhash64("text").alias("print"), "text", F.btrim(F.regexp_replace("text", _SPACE, " "), F.lit(" ")).alias("flat"))
    d = d.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length("flat") - F.greatest(F.col("n_words") - 1, F.lit(0)))
    d = d.withColumn("n_symbols", (F.size(F.split("text", _SYMBOLS, -1)) - 1).cast("long"))
    d = d.withColumn("kept_lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("kept_lines") - F.size(F.array_distinct("kept_lines"))).cast("long"))
    hashed = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - window), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(window)]))
    d = d.withColumn("windows", F.when(F.col("n_words") > window, hashed))
    counted = F.transform(F.transform("kept_lines", plain), lambda x: F.struct(line_hash(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    d = d.select("id", "host", "print", "n_words", "word_chars", "n_symbols", "n_dup_lines", counted.alias("lines"), "windows")
    # only documents with a window twice need the windows' order
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("again", F.sort_array(F.filter(F.transform("sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("again", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])
    return d.select(F.monotonically_increasing_id().alias("row"), "id", "host", "print", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "lines").withColumn("word_chars", F.col("word_chars").cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def line_counts(table: DataFrame) -> DataFrame:
    """(host, hash, documents): in how many different documents of a host a line is."""
    d = table.select("host", F.xxhash64(F.col("lines.hash")).alias("print"), F.explode(F.array_distinct("lines.hash")).alias("hash"))
    return d.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("documents"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the host as two columns that are never null, so that a null host meets a null host in a plain join."""
    return rows.withColumns({"no_host": F.col("host").isNull(), "host": F.coalesce(F.col("host").cast("string"), F.lit(""))})


def judged(table: DataFrame, max_documents: int = 20, min_share: float = 0.5, min_words: int = 20) -> DataFrame:
    """The rows of ``facts`` without their lines, with base_failed, removed_words, common (their boilerplate lines' hashes, or null) and kept."""
    common = _keyed(line_counts(table).where(F.col("documents") > max_documents)).select("no_host", "host", "hash")
    lines = _keyed(table.select("row", "host", F.explode("lines").alias("line"))).select("row", "no_host", "host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    lost = salted(lines, common, ["no_host", "host", "hash"], F.col("row")).groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_set("hash")).alias("common"))
    d = table.drop("lines").join(lost, F.col("row") == F.col("r"), "left").drop("r").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", base_failed())
    left = F.col("n_words") - F.col("removed_words")
    return d.withColumn("kept", ~F.col("base_failed") & (left >= min_share * F.col("n_words")) & (left >= min_words))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept) of every row."""
    d = judged(written(facts(docs, id_col, text_col, host_col)), **limits)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def _same(docs: DataFrame, other: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, dict, Column]:
    """``other`` (id, host, print, ...) under names that ``docs`` doesn't have, the names, and when rows of the two are the same document."""
    name = {c: fresh(f"_{c}", docs.columns) for c in other.columns}
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(name["id"])) & F.col(f"`{host_col}`").eqNullSafe(F.col(name["host"])) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(name["print"]))
    return other.select(*[F.col(c).alias(n) for c, n in name.items()]), name, same


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that ``assess`` keeps, with their columns as they were. Equal ids, hosts and texts share their fate."""
    d = judged(written(facts(docs, id_col, text_col, host_col)), **limits)
    out, _, same = _same(docs, d.where(~F.col("kept")).select("id", "host", "print").distinct(), id_col, text_col, host_col)
    return docs.join(out, same, "left_anti")


def clean_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``keep_good`` without their boilerplate lines; the other columns as they were."""
    d = judged(written(facts(docs, id_col, text_col, host_col)), **limits)
    other, name, same = _same(docs, d.where(~F.col("kept") | F.col("common").isNotNull()).select("id", "host", "print", "kept", "common").distinct(), id_col, text_col, host_col)
    left = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x: ~F.array_contains(name["common"], line_hash(plain(x))))
    text = F.when(F.col(name["common"]).isNull(), F.col(f"`{text_col}`")).otherwise(F.concat_ws("\n", left))
    good = docs.join(other, same, "left").where(F.coalesce(name["kept"], F.lit(True)))
    return good.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = 20) -> DataFrame:
    """(id, text) of every document without its boilerplate lines, in order; texts can become empty."""
    names = {"i": id_col, "t": text_col, "h": host_col}
    d = docs.select(*[F.col(c).alias(k) for k, c in names.items()], F.monotonically_increasing_id().alias("row"))
    d = written(d.select("row", "i", "h", F.posexplode_outer(F.split("t", "\n", -1)).alias("at", "line")))
    flat = plain(F.col("line"))
    d = d.withColumn("hash", F.when(flat != "", line_hash(flat)))
    common = line_counts(facts(docs, id_col, text_col, host_col)).where(F.col("documents") > max_documents).select(F.col("host").alias("ch"), F.col("hash").alias("cx"))
    left = d.join(common, d.h.eqNullSafe(common.ch) & (d.hash == common.cx), "left").groupBy("row").agg(F.first("i").alias(id_col), F.sort_array(F.collect_list(F.when(F.col("cx").isNull(), F.struct("at", "line")))).alias("kept"))
    return left.select(id_col, F.concat_ws("\n", F.col("kept.line")).alias(text_col))
