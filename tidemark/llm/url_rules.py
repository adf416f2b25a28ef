"""URL filters (operator 3): listed rules, and association rules mined from labels. DataFrame and SQL functions only.

Listed rules name a host (with all its subdomains) and the start of a path; the longest that fits decides. Where none
fits, the method decides: every URL is a set of tokens (labels of the host, words of the path, query keys, fragment);
frequent token sets of bad pages are mined with FP-growth, and a set that goes with bad pages by ``confidence``
(and above the general share by ``lift``, or by half of what is left up to 1) blocks. Rules match by an inverted index:
each rule is filed under its rarest tokens, pages meet it there, and a page that holds all tokens of the rule is blocked.

A rule needs the share ``support`` of the labelled pages and at least ``least`` of them, as fewer pages show nothing.
So a token of too few bad pages is in no rule, and only bad pages have to be mined; how many pages hold a set at all is
counted over the good ones by the same inverted index. Tokens that lie in exactly the same labelled pages are one class:
a set of them counts as the set of its classes does, so classes are mined, and a rule stands for all choices of tokens
from its classes. No set is left out, however long a URL is. The mining costs as much as there are sets of classes in
``support`` pages, which doubles with every further class that the same bad pages share.

At most the mean number of tokens of a URL over ``support`` tokens are in rules, whatever the input. Hot tokens are met
by salted joins; rules are broadcast up to ``FEW_RULES``.

Defined results: a null URL, or one without ``://``, has empty host and path and no tokens, and is allowed; repeated
rows and null ids come out as they went in; without labels no rule is mined; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import salted, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules, of some hundred bytes each, the index is broadcast.
FEW_RULES = 50_000
#: ``matched`` is exact below this number, and stays there: doubles hold no greater whole numbers exactly.
MANY = 1 << 53


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by a short list of (verdict, rule) pairs, such as ("block", "example.org/es/"); null where none fits.

    The list is part of the plan, so it suits lists that people write, not millions of entries.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; numbers are all one token, as they name single pages."""
    mark = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    found = F.concat(mark("host:", F.split(host, r"\.")), mark("path:", F.split(F.lower(path), r"[^a-zA-Z0-9]+")), mark("query:", keys), F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def classed(baskets: DataFrame, floor: int) -> DataFrame:
    """(class, tokens, n, n_bad) of the tokens in ``floor`` bad pages at least, from (row, tokens, bad).

    The tokens of a class lie in exactly the same pages, as 128 bits of hash over the pages' rows tell.
    """
    each = baskets.select("row", "bad", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"mark{k}") for k in (0, 1)]
    found = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *marks).where(F.col("n_bad") >= floor)
    return found.groupBy("n", "n_bad", "mark0", "mark1").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("class"), "tokens", "n", "n_bad")


def mined(baskets: DataFrame, support: float = 0.002, least: int = 20, confidence: float = 0.6, lift: float = 2.0) -> DataFrame:
    """(anchor, tokens, rest) of rules whose consequence is a bad page, from (row, tokens, bad): the rarest class's tokens, and the other classes'.

    No lift exceeds 1 / the share of bad pages. So a rule whose confidence lies half of the way from that share to 1 is
    enough as well; below a share of 1/3 this asks for more than a lift of 2 does.
    """
    from pyspark.ml.fpm import FPGrowth

    pages, bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).collect()[0]
    floor = math.ceil(max(support * pages, least))
    if floor > bad:
        return baskets.select(F.col("tokens").alias("anchor"), "tokens", F.array("tokens").alias("rest")).where(F.lit(False))
    classes = written(classed(baskets, floor))
    each = baskets.select("row", "bad", F.explode("tokens").alias("class"))
    items = written(salted(each, classes.select("class"), ["class"], F.col("row")).groupBy("row", "bad").agg(F.collect_list("class").alias("items")))
    mined_pages = items.where("bad").count()
    if not mined_pages:
        return baskets.select(F.col("tokens").alias("anchor"), "tokens", F.array("tokens").alias("rest")).where(F.lit(False))
    # half a page less than the floor, as the share is multiplied by the pages and rounded up
    sets = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / mined_pages).fit(items.where("bad")).freqItemsets
    sets = written(sets.select(F.sort_array("items").alias("set"), F.col("freq").alias("n_bad")))

    known = sets.select("set", F.explode("set").alias("class")).join(classes.select("class", "n"), "class")
    sets = written(sets.join(known.groupBy("set").agg(F.min_by("class", F.struct("n", "class")).alias("anchor")), "set"))
    good = items.where("not bad").groupBy(F.sort_array("items").alias("items")).agg(F.count(F.lit(1)).alias("c"))  # equal ones meet the sets once
    good = good.select("items", "c", F.explode("items").alias("anchor"))
    filed = sets.select("set", "anchor")
    near = good.join(F.broadcast(filed), "anchor") if filed.count() <= FEW_RULES else salted(good, filed, ["anchor"], F.col("items"))
    held = near.where(F.size(F.array_intersect("items", "set")) == F.size("set")).groupBy("set").agg(F.sum("c").alias("n_good"))
    share, sure = bad / pages, F.col("n_bad") / (F.col("n_bad") + F.coalesce("n_good", F.lit(0)))
    enough = (sure >= confidence) & ((sure >= lift * share) | (F.lit(share < 1) & (sure >= (1 + share) / 2)))
    rules = sets.join(held, "set", "left").where(enough).select("set", "anchor")

    full = rules.select("set", F.col("anchor").alias("head"), F.explode("set").alias("class")).join(classes.select("class", "tokens"), "class")
    first = F.max(F.when(F.col("class") == F.col("head"), F.col("tokens"))).alias("tokens")
    rest = F.collect_list(F.when(F.col("class") != F.col("head"), F.col("tokens"))).alias("rest")
    return full.groupBy("set").agg(first, rest).select(F.col("tokens").alias("anchor"), "tokens", "rest")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", bad_value: int = 0, **mining) -> DataFrame:
    """(id, host, path, rule, verdict, matched) of every page; matched: how many mined rules the URL meets, at most ``MANY``, if it is the method's verdict."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    p = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    p = written(p.select("row", "id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")))

    bad = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("key")).agg((F.avg((F.col(label_col) == bad_value).cast("double")) > 0.5).alias("bad"))
    known = p.where(F.size("tokens") > 0).join(bad, F.col("id") == F.col("key"))
    baskets = written(known.select("row", "tokens", "bad"))
    filed = mined(baskets, **mining)
    filed = written(filed.withColumn("anchor", F.explode("anchor")))

    open_pages = p.where(F.col("verdict").isNull()).select("row", F.col("tokens").alias("own"), F.explode("tokens").alias("anchor"))
    near = open_pages.join(F.broadcast(filed), "anchor") if filed.count() <= FEW_RULES else salted(open_pages, filed, ["anchor"], F.col("row"))
    # a page with several tokens of the rarest class meets the rule once
    met = near.where((F.col("anchor") == F.array_min(F.array_intersect("tokens", "own"))) & F.forall("rest", lambda c: F.arrays_overlap(c, "own")))
    choices = lambda c: F.pow(F.lit(2.0), F.size(F.array_intersect(c, "own"))) - 1
    met = met.select("row", F.aggregate("rest", choices(F.col("tokens")), lambda n, c: n * choices(c)).alias("rules"))
    hits = met.groupBy(F.col("row").alias("r")).agg(F.least(F.sum("rules"), F.lit(float(MANY))).cast("long").alias("matched"))
    out = p.drop("tokens").join(hits, F.col("row") == F.col("r"), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("matched") > 0, "block").otherwise("allow")).alias("verdict"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))
