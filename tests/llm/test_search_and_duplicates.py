"""Near duplicates, the archive audit, search and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bm25, common, near_dup, warc_audit


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, root string")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {(len(w), *w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=4, groups=12, size=10):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.5:
                base = w  # chains, whose ends are alike only through their middle
            rows.append(" ".join(w).title() if rng.random() < 0.3 else "\n ".join(w))
    rows += ["", " \t", None, "one", "ONE", "one two", "one two three four", "One\ntwo three four", "a a a a a a", "a a a a a a a", "é à ü ö ß", "É à ü ö ß", "long " * 30_000, rows[0], rows[3]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    got = near_dup.components(docs(spark, [(i, t, "k", "r") for i, t in rows]).repartition(5)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 3)):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dup.components(docs(spark, [(i, t, "k", "r") for i, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_sets_are_looked_up_where_large_groups_meet(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("IN_PLACE", 0), ("HOT", 3), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(near_dup, name, value)
    monkeypatch.setattr(near_dup, "SET_BYTES", 5_000)
    rows = corpus(seed=21, groups=16, size=16)
    got = near_dup.components(docs(spark, [(i, t, "k", "r") for i, t in rows]).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_more_buckets_of_sets_than_shuffle_partitions(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SET_BYTES", 5_000)
    rows = corpus(seed=33)
    want = brute_components(rows)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_dup.components(docs(spark, [(i, t, "k", "r") for i, t in [*rows, rows[0], (None, rows[1][1])]])).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want and len(got) == len(rows) + 2


def test_set_files_find_every_set(spark):
    texts = spark.createDataFrame([(i * 7, " ".join(f"{i}w{k}" for k in range(i % 50))) for i in range(3000)], "id long, text string")
    sets, files = near_dup.shingle_sets(texts.unionByName(texts), texts.where("id % 2 = 0").select("id"), 50)
    files.CACHE_BYTES, files.OPEN = 1000, 3
    rows = sets.withColumn("bucket", near_dup.bucket_of("id", 50)).collect()
    assert len(rows) == 1500 and files.files == 50
    assert all(np.array_equal(files.get(r["id"], r["bucket"]), np.frombuffer(r["hashes"], "<u8")) and len(r["hashes"]) == 8 * r["n"] for r in rows) and len(files.open) == 3
    plan = sets.join(texts.select("id").hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_recall_near_the_threshold(spark):
    """Pairs of texts about 0.75 alike, each on its own: all links, and no others."""
    rng = random.Random(77)
    rows, want = [], {}
    for k in range(3000):
        n = rng.randint(30, 150)
        a = [f"{k}w{i}" for i in range(n)]
        b = list(a)
        for i in rng.sample(range(n), max(1, round(n * rng.uniform(0.02, 0.035)))):
            b[i] = "x" + b[i]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = 2 * k if 100 * len(x & y) >= 75 * len(x | y) else 2 * k + 1
    got = {r["doc_id"]: r["component_id"] for r in near_dup.components(docs(spark, [(i, t, "k", "r") for i, t in rows])).collect()}
    assert 1000 < sum(i != c for i, c in want.items()) < 2900 and all(got[i] == c for i, c in want.items())


def test_a_hub_with_half_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 50)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: i % 99], f"x{i}", *base[i % 99 + 1 :]])) for i in range(600)] + [(600 + i, " ".join(f"{i}y{k}" for k in range(30))) for i in range(600)]
    d = docs(spark, [(i, t, "k", "r") for i, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.components(d).collect()}
    assert all(got[i] == 0 for i in range(600)) and all(got[i] == i for i in range(600, 1200))


def test_clashing_columns_stay(spark):
    text = "some words that are long enough to make shingles of"
    d = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b")], "doc_id long, text string, _id long, _ID_ string")
    assert [tuple(r) for r in near_dup.keep_one(d).collect()] == [(1, text, 5, "a")]


def test_duplicate_edge_cases(spark):
    assert near_dup.components(docs(spark, [])).collect() == []
    text = "some words that are long enough to make shingles of"
    d = docs(spark, [(None, text, "k", "r"), (7, text, "k", "r"), (7, text, "k", "r"), (9, text, "k", "r")])
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dup.components(d).collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = near_dup.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 7, 7]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.75, 0.9):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        common_part, rest = a[: int(2000 * share)], rng.integers(0, 1 << 63, 2000 - int(2000 * share), dtype=np.uint64)
        b = np.concatenate([common_part, rest])
        x, y = near_dup.registers(a), near_dup.registers(b)
        assert (near_dup.merge(x, y) == near_dup.registers(np.union1d(a, b))).all()
        best, ok = near_dup.plausible(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(best[0] - j) < 0.15 and (ok[0] or j < 0.7)


def test_search_is_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"t{int(rng.expovariate(0.02))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(1500)]
    rows += [(1500 + i, rows[100][1]) for i in range(30)] + [(1600, None), (1700, ""), (None, "t1 t2"), (1800, "T1 t2 " * 20_000)]
    d = docs(spark, [(i, t, "k", "r") for i, t in rows]).repartition(6)
    got = bm25.search(d, d.where("doc_id % 100 = 0"), k=10).collect()
    bags = {i: Counter((t or "").encode().lower().split()) for i, t in rows if i is not None}
    n, average = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    for q in (i for i in bags if i % 100 == 0):
        scores = []
        for i, b in bags.items():
            norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / average)
            if s := sum(idf[t] * b[t] * 2.2 / (b[t] + norm) for t in bags[q] if t in b):
                scores.append((-round(s, 5), i))
        want = sorted(scores)[:10]
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [round(s, 4) for *_, s in mine] == pytest.approx([-s for s, _ in want], abs=2e-4)
        assert [i for _, i, _ in mine] == [i for _, i in want], q


def test_search_in_small_shards(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"a b c{i % 7} d{i % 3} e{i} " + " ".join(f"f{rng.randrange(50)}" for _ in range(rng.randrange(20)))) for i in range(600)]
    d = docs(spark, [(i, t, "k", "r") for i, t in rows])
    one = bm25.search(d, d.where("doc_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    few = bm25.search(d.repartition(9), d.where("doc_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    for name, value in (("SHARD_DOCS", 37), ("SHARD_POSTINGS", 300), ("QUERIES", 4), ("FILES", 2), ("BLOCK", 8)):
        monkeypatch.setattr(bm25, name, value)
    tiny = bm25.search(d.repartition(3), d.where("doc_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert one == few == tiny and len(one) == 150
    assert bm25.search(docs(spark, []), docs(spark, []), k=5).collect() == []
    assert bm25.search(d, d.where("doc_id < 0"), k=5).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string")


def test_audit_finds_every_damaged_record(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 90) + str(i), "f") for i in range(700)] + [(700, None, None, "f"), (None, "a\r\nb", "", "f"), (701, "u", "é" * 50_000, "f"), (5, "http://h/5", "again", "f")]
    d = pages(spark, rows).repartition(3)
    folder = common.shared_folder(spark)
    index = warc_audit.write_archive(d, f"{folder}/one")
    warc_audit.copy_files(index, f"{folder}/one", f"{folder}/same")
    hurt = index.where("id % 97 = 3").select("file", (F.col("offset") + F.col("length") - 1).alias("at"))
    warc_audit.copy_files(index, f"{folder}/one", f"{folder}/two", hurt)
    one, same, two = (warc_audit.trees(index, f"{folder}/{k}") for k in ("one", "same", "two"))
    assert warc_audit.archive_root(one) == warc_audit.archive_root(same) != warc_audit.archive_root(two)
    assert warc_audit.audit(one, same).collect() == []
    found = warc_audit.audit(one, two).join(index, ["file", "number"]).collect()
    assert sorted(r["id"] for r in found) == [i for i in range(702) if i % 97 == 3]
    by_id = {}
    for r in index.collect():
        fs, root = common.filesystem(f"{folder}/one")
        with fs.open_input_file(f"{root}/{r['file']}") as f:
            f.seek(r["offset"])
            by_id.setdefault(r["id"], []).append(warc_audit.read_record(f.read(r["length"])))
    assert by_id[701][0][1] == ("é" * 50_000).encode() and by_id[None][0][0]["WARC-Target-URI"] == "a%0D%0Ab" and "WARC-Target-URI" not in by_id[700][0][0]
    assert len(by_id[5]) == 2
    gone = index.select("file").orderBy("file").first()["file"]
    fs, root = common.filesystem(f"{folder}/same")
    fs.delete_file(f"{root}/{gone}")
    lost = warc_audit.audit(one, warc_audit.trees(index, f"{folder}/same"))
    assert {(r["file"], r["number"]) for r in lost.collect()} == {(r["file"], r["number"]) for r in index.where(index.file == gone).collect()}


def test_audit_finds_appended_bytes_and_other_files(spark):
    d = pages(spark, [(i, f"u{i}", f"body {i}", "f") for i in range(100)]).repartition(2)
    folder = common.shared_folder(spark)
    index = warc_audit.write_archive(d, f"{folder}/one")
    warc_audit.copy_files(index, f"{folder}/one", f"{folder}/two")
    one = warc_audit.trees(index, f"{folder}/one")
    fs, root = common.filesystem(f"{folder}/two")
    ends = {r["file"]: (r["n"], r["end"]) for r in index.groupBy("file").agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()}

    def write(name, data):
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(data)

    def differ(expected):
        two = warc_audit.trees(index, f"{folder}/two")
        assert (warc_audit.archive_root(one) == warc_audit.archive_root(two)) == (not expected)
        for x, y in ((one, two), (two, one)):
            assert {(r["file"], r["number"], r["start"], r["end"]) for r in warc_audit.audit(x, y).collect()} == expected

    differ(set())
    name = min(ends)
    n, end = ends[name]
    with fs.open_input_file(f"{root}/{name}") as f:
        whole = f.read()
    write(name, whole + b"more")
    differ({(name, n, end, end + 4)})
    write(name, whole)
    write("part-000099.warc.gz", b"else")
    write("empty", b"")
    differ({("part-000099.warc.gz", 0, 0, 4), ("empty", 0, 0, 0)})
    fs.delete_file(f"{root}/part-000099.warc.gz")
    fs.delete_file(f"{root}/empty")
    write(name, whole[:-1])
    last = index.where((F.col("file") == name) & (F.col("number") == n - 1)).first()["offset"]
    differ({(name, n - 1, last, end)})


def test_no_files_for_no_pages(spark):
    folder = common.shared_folder(spark)
    index = warc_audit.write_archive(pages(spark, [(1, "u", "b", "f")]).repartition(3), folder)
    assert warc_audit.files(folder) == [r["file"] for r in index.collect()]


def test_drill(spark):
    rows = [(i, f"u{i}", f"body {i}", "f") for i in range(300)]
    d = pages(spark, rows)
    got = warc_audit.drill(d, F.col("page_id") % 50 == 7).collect()
    assert {r["page_id"] for r in got if not r["intact"]} == {i for i in range(300) if i % 50 == 7} and len(got) == 300
    assert warc_audit.drill(pages(spark, []), F.col("page_id") == 1).collect() == []


def test_pipeline_by_its_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs_, seen = start, {}
    for name, stage in pipeline.STAGES:
        docs_ = common.written(stage(spark, docs_, sf))
        seen[name] = docs_
    for name in list(seen)[:-1]:
        assert seen[name].columns == start.columns
    from tidemark.llm import line_rules, quality_model

    kept = {r["doc_id"] for r in line_rules.assess(start).where("kept").collect()}
    assert {r["doc_id"] for r in seen["quality_rules"].collect()} == kept
    good = {r["doc_id"] for r in quality_model.classify(start, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in seen["quality_classifier"].collect()} == kept & good
    rows = [(r["doc_id"], r["text"]) for r in start.collect() if r["doc_id"] in kept & good]
    alone = {i for i, (_, c) in brute_components(rows).items() if i == c}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == alone
    assert {r["doc_id"] for r in seen["packing"].collect()} == alone
    assert sorted(pipeline.run(spark, sf).collect()) == sorted(seen["packing"].collect())
