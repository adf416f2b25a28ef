"""URL rules, quality rules and the classifier."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_rules, quality_model, url_rules

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_listed_rules(spark):
    urls = {
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://m.example.org/en/12?x#y": ("m.example.org", "/en/12", "example.org/en/1", "block"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
        "http://org": ("org", "", None, "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b.net?q=http://x/y": ("b.net", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    got = url_rules.judge(pages(spark, [*urls, None]), labels(spark, []), RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [*urls.values(), ("", "", None, "allow")]


def url_tokens(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    if not host:
        return set()
    query = re.match(r"[^?#]*\?([^#]*)", url)
    keys = [re.match("[^=]*", k).group() for k in query.group(1).split("&")] if query else []
    parts = [("host:", host.translate({c: c + 32 for c in range(65, 91)}).split(".")), ("path:", re.split("[^a-zA-Z0-9]+", path.lower())), ("query:", keys)]
    return {kind + re.sub("[0-9]+", "0", x) for kind, xs in parts for x in xs if x} | ({"fragment"} if "#" in url else set())


def brute_rules(urls, bad, support=0.002, least=20, confidence=0.6, lift=2.0):
    """Every set of a URL's tokens, counted on its own; none of the URLs has more tokens than a rule can."""
    known = {i: url_tokens(urls[i]) for i in bad if url_tokens(urls[i])}
    n, share = len(known), sum(bad[i] for i in known) / max(len(known), 1)
    counts, hits = {}, {}
    for i, tokens in known.items():
        assert len(tokens) <= 10
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                counts[c] = counts.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + bad[i]
    floor = math.ceil(max(support * n, least))
    return {c for c, h in hits.items() if h >= floor and h / counts[c] >= confidence and (h / counts[c] >= lift * share or share < 1 and h / counts[c] >= (1 + share) / 2)}


def check_rules(spark, urls, marks, **how):
    bad = {i: q == 0 for i, q, _ in marks if i is not None and q is not None}
    rules = brute_rules(urls, bad, **how)
    got = url_rules.judge(pages(spark, urls), labels(spark, marks), RULES, **how).collect()
    assert len(got) == len(urls)
    for r in got:
        matched = sum(set(c) <= url_tokens(urls[r["page_id"]]) for c in rules) if r["rule"] is None else 0
        assert r["matched"] == matched
        assert r["rule"] is not None or r["verdict"] == ("block" if matched else "allow")
    return rules, got


def test_mined_rules_block_what_goes_with_bad_labels(spark):
    urls, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        urls.append(f"http://{'casino' if bad else 'news'}{'' if i % 8 else '.blog'}.net/{'win' if bad else 'read'}/{i}?ref=x")
        if i < 200:
            marks.append((i, 0 if bad else 1, 0))
    rules, got = check_rules(spark, urls, [*marks, (None, 0, 0)])
    assert ("host:casino",) in rules and all((r["verdict"] == "block") == ("casino" in r["host"]) for r in got)


def test_rules_at_the_querys_parameters_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in "abcdefghij"]
    urls, marks = [], []
    for i in range(1500):
        host, path, key = (str(rng.choice(words)) for _ in range(3))
        urls.append(f"http://{host}.Net/{path}/{i}?{key}=1" + ("#top" if rng.random() < 0.3 else ""))
        risky = (host == "wa") + (path == "wb" and key == "wc") * 2 + (host == "wd" and "#" in urls[-1])
        marks.append((i, int(rng.random() > (0.1, 0.65, 0.95)[min(risky, 2)]), 0))
    rules, got = check_rules(spark, urls, marks[:1200])
    assert {len(c) for c in rules} >= {1, 2} and any(r["verdict"] == "block" for r in got)
    assert check_rules(spark, urls, marks[:90], least=40)[0] == set()


def test_real_pages_are_judged_as_by_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    p = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    bad = {r["doc_id"]: r["quality"] == 0 for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in p}
    rules = brute_rules(p, bad)
    got = url_rules.judge(spark.read.parquet(f"{folder}/pages.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), RULES).collect()
    assert all(r["matched"] == (sum(set(c) <= url_tokens(p[r["page_id"]]) for c in rules) if r["rule"] is None else 0) for r in got)


def test_rules_of_twelve_tokens_and_rules_behind_twelve_others(spark):
    words, others = ([f"{x}{c}" for c in "abcdefghijkl"] for x in "st")
    urls = [f"http://x.net/{'/'.join(words)}"] * 100 + [f"http://y.net/{'/'.join([*others, 'left', 'right'])}"] * 100
    # of good pages, all but one of the twelve words are in 70 of 840; the twelve others in a third, left or right in half
    urls += [f"http://x.net/{'/'.join(w for w in words if w != words[i % 12])}" for i in range(840)]
    urls += [f"http://y.net/{'/'.join([*(others if i % 3 == 0 else []), ('left', 'right')[i % 2]])}" for i in range(300)]
    marks = [(i, int(i >= 200), 0) for i in range(len(urls))]
    new = ["http://y.net/left/right", "http://x.net/" + "/".join(words), "http://x.net/" + "/".join(words[1:])]
    got = url_rules.judge(pages(spark, urls + new), labels(spark, marks), RULES).where(f"page_id >= {len(urls)}").orderBy("page_id").collect()
    assert [(r["verdict"], r["matched"]) for r in got] == [("block", 4), ("block", 4), ("allow", 0)]  # each with or without two labels of the host


def test_long_urls_cost_no_exponential_mining(spark):
    long = "/".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    urls = [f"http://casino.net/{long}/{i}" if i % 3 == 0 else f"http://news{i}.net/{i}" for i in range(300)]
    got = url_rules.judge(pages(spark, urls), labels(spark, [(i, int(i % 3 != 0), 0) for i in range(200)]), RULES).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)
    few = url_rules.judge(pages(spark, urls), labels(spark, [(i, int(i % 3 != 0), 0) for i in range(30)]), RULES).collect()
    assert all(r["verdict"] == "allow" for r in few)  # ten bad pages show nothing
    beyond, url_rules.FEW_RULES = url_rules.FEW_RULES, 0
    try:
        assert sorted(url_rules.judge(pages(spark, urls), labels(spark, [(i, int(i % 3 != 0), 0) for i in range(200)]), RULES).collect()) == sorted(got)
    finally:
        url_rules.FEW_RULES = beyond
    assert url_rules.judge(pages(spark, ["http://a.net/" + "x" * 200_000]), labels(spark, []), RULES).first()["verdict"] == "allow"


@pytest.mark.parametrize("bad_of_ten", [1, 4, 6, 9])
def test_rules_are_mined_at_every_share_of_bad_pages(spark, bad_of_ten):
    urls = [f"http://{'casino' if i % 10 < bad_of_ten else 'news'}.net/{i}" for i in range(300)]
    marks = [(i, int(i % 10 >= bad_of_ten), 0) for i in range(300)]
    got = url_rules.judge(pages(spark, urls), labels(spark, marks), RULES, support=0.02).collect()
    assert all((r["verdict"] == "block") == ("casino" in r["host"]) for r in got) and len(got) == 300


def test_all_pages_bad_or_none(spark):
    urls = [f"http://a.net/{i}" for i in range(50)]
    for quality in (0, 1):
        got = url_rules.judge(pages(spark, urls), labels(spark, [(i, quality, 0) for i in range(50)]), RULES, support=0.02).collect()
        assert all(r["verdict"] == "allow" for r in got)


def test_no_pages(spark):
    assert url_rules.judge(pages(spark, []), labels(spark, [(1, 0, 0)]), RULES).collect() == []


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")


def brute(text, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = {}
    for i in range(len(words) - window + 1):
        wins.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(window)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark, sf):
    rng = np.random.default_rng(0)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h i", "a " * 30, "x\x0by\x0cz\u00a0w", "|#*|\n|#*|\n\n\n", "é ü\ré ü\né ü", "word " * 30_000, "\x00a <b> & 100%"]
    texts += [" ".join(rng.choice(["a", "b", "c"], size=rng.integers(1, 60))) for _ in range(60)]
    d = docs(spark, [(i, t, "s", "k") for i, t in enumerate(texts)] + [(None, None, None, None)])
    got = {r["doc_id"]: r for r in line_rules.assess(d).collect()}
    for i, t in enumerate([*texts]):
        r, want = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t[:80])
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert got[None]["n_words"] == 0 and not got[None]["kept"]


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


def test_depleted_documents_go_and_copies_stay(spark):
    shared = [words(k, 15) for k in range(3)]
    rows = [(i, "\n".join([*shared, words(1000 + i, 8)]), "h", "") for i in range(30)]  # most of it is everywhere
    own = {i: "\n".join(words(50 * i + k, 10) for k in range(8)) for i in range(100, 160)}
    rows += [(i, "\n".join([*(x.upper() for x in shared), t]), "h", "") for i, t in own.items()]
    copy = "\n".join(words(k, 20) for k in range(50, 53))
    rows += [(200 + i, copy, "h", "") for i in range(40)]
    near = [words(k, 20) for k in range(60, 70)]
    rows += [(300 + i, "\n".join([*near[: i % 10], words(3000 + i, 20), *near[i % 10 + 1 :]]), "h", "") for i in range(15)]
    rows += [(400 + i, "\n".join([*shared, words(4000 + i, 8)]), f"h{i}", "") for i in range(30)]  # each on a host of its own
    got = {r["doc_id"]: r for r in line_rules.assess(docs(spark, rows)).collect()}
    assert not any(got[i]["kept"] for i in range(30))
    assert all(got[i]["kept"] for i in [*range(100, 160), *range(200, 240), *range(300, 315), *range(400, 430)])
    assert all(got[i]["removed_words"] == 45 for i in range(100, 160))
    d = docs(spark, [*rows, rows[0], rows[60]])
    kept = line_rules.keep_good(d)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    cut = {r["doc_id"]: r["text"] for r in line_rules.without_common_lines(docs(spark, rows)).collect()}
    assert cut[0] == words(1000, 8) and cut[100] == own[100] and cut[200] == copy


def test_templates_of_several_lines_are_boilerplate_and_copies_are_not(spark):
    shared = [words(k, 15) for k in range(12)]
    rows = [(i, "\n".join([*shared, words(1000 + i, 15)]), "h", "") for i in range(100)]
    mixes = [words(k, 15) for k in range(20, 28)]  # nothing but template lines, in varying mixes
    rows += [(200 + i, "\n".join(x for k, x in enumerate(mixes) if i >> k & 1), "mixed", "") for i in range(3, 256)]
    rows += [(1000 + i, "\n".join(x.upper() if i % 2 else f"  {x}" for x in shared), "copied", "") for i in range(50)]
    got = {r["doc_id"]: r for r in line_rules.assess(docs(spark, rows)).collect()}
    assert all(got[i]["removed_words"] == 180 and not got[i]["kept"] for i in range(100))
    assert all(got[i]["removed_words"] == got[i]["n_words"] for i in range(203, 456))
    assert all(got[i]["removed_words"] == 0 and got[i]["kept"] for i in range(1000, 1050))


def test_pipeline_goes_on_without_boilerplate_lines(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    shared = [words(k, 15) for k in range(3)]
    own = {i: [words(50 * i + k, 20) for k in range(8)] for i in range(30)}
    rows = [(i, "\n".join([shared[0], *x[:4], f"  {shared[1].upper()}", "", *x[4:], shared[2]]), "h") for i, x in own.items()]
    rows += [(100 + i, "\n".join([*shared, words(9000 + i, 8)]), "h") for i in range(5)]  # depleted
    rows += [(200, "\n".join([*shared, *own[9]]), None), (None, rows[3][1], "h"), rows[4], (201, None, "h")]
    d = spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.quality_rules(spark, d, "")
    assert got.schema == d.schema
    clean = {i: "\n".join([*x[:4], "", *x[4:]]) for i, x in own.items()}
    want = [*clean.items(), (200, rows[35][1]), (None, clean[3]), (4, clean[4])]
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in got.collect()) == sorted((str(i), t, len(t)) for i, t in want)
    cut = {(r["doc_id"], r["text"]) for r in line_rules.without_common_lines(d).collect()}
    assert {(r["doc_id"], r["text"]) for r in got.collect()} <= cut


def test_columns_that_clash_with_internal_ones(spark):
    shared = [words(k, 15) for k in range(3)]
    rows = [(i, "\n".join([*shared, words(1000 + i, 30 if i % 2 else 8)]), "h", i, "a", "b", True, ["c"], 5, "d") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _host string, _print string, _kept boolean, _common array<string>, row long, `Host` string")
    kept, clean = line_rules.keep_good(d, min_share=0.3), line_rules.clean_good(d, min_share=0.3)
    assert kept.schema == clean.schema == d.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in clean.collect()) == list(range(1, 30, 2))
    assert {r["text"] for r in clean.collect()} == {words(1000 + i, 30) for i in range(1, 30, 2)}


def test_a_null_host_is_a_host_and_one_line_can_be_very_long(spark):
    shared = words(1, 15)
    rows = [(i, f"{shared}\n{words(1000 + i, 40)}", None if i % 2 else "", "") for i in range(60)]
    rows += [(100, "word " * 200_000, None, ""), (101, "x" * 1_000_000, None, "")]
    got = {r["doc_id"]: r for r in line_rules.assess(docs(spark, rows)).collect()}
    assert all(got[i]["removed_words"] == 15 and got[i]["kept"] for i in range(60))
    assert got[100]["n_words"] == 200_000 and got[100]["base_failed"] and got[101]["word_chars"] == 1_000_000


def test_no_documents(spark):
    assert line_rules.assess(docs(spark, [])).collect() == []


def test_trees_learn_and_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    t = quality_model.fit(x[:2000], y[:2000], trees=60)
    assert ((t.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = quality_model.Trees(0.5, t.feature[:1], t.threshold[:1], t.value[:1], t.depth)
    for row in x[:50]:  # a walk by hand
        k = 0
        while k < 2**t.depth - 1:
            k = 2 * k + 1 + (row[t.feature[0, k]] > t.threshold[0, k])
        assert np.isclose(one.margins(row[None])[0], 0.5 + t.value[0, k - (2**t.depth - 1)])


def plain_fit(x, y, trees, depth, bins, rate, l2, least):
    """Boosting by loops over all rows, features and cuts; scores of the rows it learns from."""
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)

        def grow(rows, level):
            best = (1e-6, None, None)
            if level < depth:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        a, b = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                        if min(len(a), len(b)) >= least:
                            gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - whole
                            if gain > best[0] + 1e-12:
                                best = (gain, f, e)
            if best[1] is None:
                margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                return
            grow(rows[x[rows, best[1]] <= best[2]], level + 1)
            grow(rows[x[rows, best[1]] > best[2]], level + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_is_boosting_by_loops(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 5, 300), rng.random(300)])
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 2) | (rng.random(300) < 0.1)).astype(float)
    how = {"trees": 6, "depth": 3, "bins": 16, "rate": 0.3, "l2": 1.0, "least": 10}
    assert np.allclose(quality_model.fit(x, y, **how).scores(x), plain_fit(x, y, **how), atol=1e-6)


def test_scores_of_the_query_are_those_of_its_trees(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in d.collect()}
    marks = {r["doc_id"]: r["quality"] for r in lab.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    ids = [r["doc_id"] for r in lab.where(lab.doc_id.isin([*marks])).orderBy(F.xxhash64("doc_id")).collect()]  # the order of sums decides between equal cuts
    trees = quality_model.fit(quality_model.feature_rows([texts[i] for i in ids]), np.array([marks[i] for i in ids]))
    got = {r["doc_id"]: r for r in quality_model.classify(d, lab).collect()}
    want = trees.scores(quality_model.feature_rows([texts[i] for i in got]))
    assert all(abs(r["score"] - w) < 1e-9 and r["predicted"] == int(w >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for (i, r), w in zip(got.items(), want, strict=True))


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    r = quality_model.classify(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert len(r) > 500 and r["score"].between(0, 1).all()
    assert (r["predicted"] == r["quality"]).mean() > 0.95


def test_classifier_edge_cases(spark):
    d = docs(spark, [(1, None, "s", "k"), (None, "text", "s", "k"), (2, "", "s", "k"), (2, "x " * 100_000, "s", "k")])
    r = quality_model.classify(d, labels(spark, [])).collect()
    assert [x["score"] for x in r] == [0.5] * 4 and sum(x["held_out"] for x in r if x["doc_id"] is None) == 0
    assert quality_model.classify(docs(spark, []), labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 1)])).collect() == []
    t = quality_model.learn(d, labels(spark, [(1, 1, 0), (2, None, 0)]))
    kept = quality_model.keep_good(d, t)
    assert kept.columns == d.columns and kept.count() == 4
    with pytest.raises(Exception):
        quality_model.keep_good(d, t, text_col="absent").collect()
