"""The corpus operators' queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bm25, line_rules, near_dup, packing, piece_codec, quality_model, sstable, token_counts, url_rules, warc_audit

#: The listed rules of the URL filter.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.assess(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill over all pages: the replica has a flipped byte in every record whose page_id leaves 13 when divided by 997."""
    return warc_audit.drill(table(spark, sf_dir, "pages"), F.col("page_id") % 997 == 13)


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2).read()


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, taken as a query whole."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
x AS (SELECT *, CASE WHEN len(words) > 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) ELSE [] END AS wins FROM w),
e AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM x),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY 1),
p AS (SELECT doc_id, source, list_transform(lines, lambda y: lower(trim(regexp_replace(y, '[\x20\x09-\x0D]+', ' ', 'g')))) AS plain FROM x),
h AS (SELECT doc_id, source, line, len(string_split(line, ' ')) AS n FROM (SELECT doc_id, source, unnest(plain) AS line FROM p)),
c AS (SELECT source, line FROM (SELECT source, array_to_string(plain, chr(10)) AS document, unnest(plain) AS line FROM p) GROUP BY 1, 2 HAVING count(DISTINCT document) > 20),
lost AS (SELECT doc_id, sum(n) AS n FROM h JOIN c ON h.line = c.line AND h.source IS NOT DISTINCT FROM c.source GROUP BY 1),
f AS (SELECT x.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda y: length(y))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
      FROM x LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.5 * n_words AND n_words - removed_words >= 20 AS kept FROM g
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [len(words)::VARCHAR || ' ' || array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: '5 ' || array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP8_SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256, page_id % 997 <> 13 AS intact FROM pages
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT count(*)::DOUBLE AS n, sum(len(words))::DOUBLE / count(*) AS average FROM w),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM w) GROUP BY 1, 2),
i AS (SELECT term, ln(1 + (g.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, g GROUP BY term, g.n),
x AS (SELECT q.doc_id AS query_id, t.doc_id, sum(idf * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(w.words) / g.average))) ORDER BY idf DESC) AS s
      FROM t q JOIN t ON t.term = q.term JOIN i ON i.term = q.term JOIN w ON w.doc_id = t.doc_id, g WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
y AS (SELECT query_id, doc_id, round(s, 6) AS score FROM x)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM y
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""

OPERATORS = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_url_filter, op4_quality_rules, op5_quality_classifier, op6_near_dup, op7_piece_codec, op8_warc_audit, op9_sstable, op10_search)}


def queries() -> dict:
    return dict(OPERATORS)


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op6_near_dup": OP6_SQL, "op8_warc_audit": OP8_SQL, "op10_search": OP10_SQL}
