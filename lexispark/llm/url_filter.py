"""URL verdicts: fixed host and path rules first, then association rules mined from labelled URLs by Spark's FP-growth, or by levels where a URL holds many items.

A labelled URL is a transaction of its tokens (scheme, host labels, path segments, names and values of the query, fragment) and, if it is bad, of the item `=bad`. Rules
`tokens => =bad` are kept at `confidence` or more over `support` of the labelled URLs or more, and `least` of them; a rule that a shorter one covers with no less confidence goes.
Rules are indexed by their rarest token; a URL meets the rules of its tokens there and is blocked if it holds all tokens of one.
All of it is DataFrame and ML operators in the JVM.

What is mined stays small, and nothing is left out: tokens that too few bad URLs hold can be in no rule and go first; tokens that the same labelled URLs hold are one item (a rule with one of them
is as good as with another, and one with two of them has a shorter one that covers it); an item of bad URLs alone is a rule, covers all with it in them, and needs no search. FP-growth lists all combinations
of a URL's other items, so it is asked while no URL holds over `most` of them. Else combinations grow by levels, an item at a time, as far as each holds fewer good URLs than all its parts: one that holds as
many as a part has no more confidence than that part, and the same is true with any further items. Both ways give the same rules. Nested paths end at once; `k` tokens that come and go by themselves in bad and
good URLs alike have up to 2**k combinations, and these are all counted, however long it takes.

Matching is done on distinct URLs, so a URL that holds a third of all rows is matched once; the verdict returns to the rows by a join on the URL.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule, holds no token and is allowed. Of repeated labels the worst counts. Without labels, or
without bad ones, nothing is mined and all URLs outside the fixed rules are allowed. Repeated rows get a verdict each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: (host, path, verdict): the longest that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A rule's least share and least number of the labelled URLs, and its least confidence.
SUPPORT, LEAST, CONFIDENCE = 0.002, 20, 0.6
#: Items of a labelled URL up to which FP-growth lists all their combinations; where one holds more, the search goes by levels.
MOST = 10
BAD = "=bad"


def host_and_path(url):
    """(host, path) expressions."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rule(host, path, rules=RULES):
    """(rule, verdict) expressions of the longest rule that fits, null if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url):
    """Distinct tokens of a URL; runs of digits are one sign, so that ids don't make tokens of their own."""
    host, path = host_and_path(url)
    low = F.lower(F.coalesce(url, F.lit("")))
    query, fragment = F.regexp_extract(low, r"\?([^#]*)", 1), F.regexp_extract(low, "#(.*)$", 1)

    def named(kind, parts):
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))

    scheme = F.when(F.instr(low, "://") > 0, F.array(F.regexp_extract(low, "^(.*?)://", 1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named("s:", scheme), named("h:", F.split(host, "[.-]")), named("p:", F.split(F.lower(path), "/")), named("q:", F.split(query, "&")), named("f:", F.array(fragment))))


def items_of(rows: DataFrame, floor: int) -> DataFrame:
    """(token, item, share): tokens that `floor` bad URLs hold at least, the item of each (the first of the tokens that just the same URLs hold), and the item's share of bad URLs. `rows`: url, tokens, bad."""
    held = rows.select("url", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("url", F.lit(i))).alias(f"x{i}") for i in range(2)]
    counted = held.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), *same).where(F.col("b") >= floor)
    firsts = counted.groupBy("n", "b", "x0", "x1").agg(F.min("token").alias("item"))
    return counted.join(firsts, ["n", "b", "x0", "x1"]).select("token", "item", (F.col("b") / F.col("n")).alias("share"))


def frequent(urls: DataFrame, floor: int, confidence: float) -> DataFrame:
    """(antecedent, confidence): the sets of items that `floor` bad URLs hold at least and that have the confidence, by FP-growth. `urls`: items (sorted), bad."""
    baskets = durable(urls.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / max(1, baskets.count())), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence")


def grown(urls: DataFrame, floor: int, confidence: float) -> DataFrame:
    """As `frequent`, by levels, and without sets that hold as many good URLs as a part of theirs, which that part covers."""
    baskets = durable(urls.groupBy("items").agg(F.count("*").alias("n"), F.sum("bad").alias("b")))
    held = baskets.select("items", "n", "b", F.explode("items").alias("item")).select("items", "n", "b", F.array("item").alias("own"))
    parts, found = None, []
    while True:
        counted = held.groupBy("own").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("b") >= floor).select("own", "b", (F.col("n") - F.col("b")).alias("g"))
        if parts is not None:
            each = counted.select("own", "b", "g", F.explode(F.transform("own", lambda x: F.array_remove("own", x))).alias("part")).join(parts, "part")
            counted = each.where("part_g > g").groupBy("own", "b", "g").agg(F.count("*").alias("k")).where(F.col("k") == F.size("own"))
        counted = durable(counted.select("own", "b", "g"))
        found.append(counted.select(F.col("own").alias("antecedent"), (F.col("b") / (F.col("b") + F.col("g"))).alias("confidence")).where(F.col("confidence") >= confidence))
        parts = counted.where("g > 0").select(F.col("own").alias("part"), F.col("g").alias("part_g"))
        if parts.isEmpty():
            return reduce(DataFrame.unionByName, found)
        kept = held.join(parts.select(F.col("part").alias("own")), "own", "left_semi")
        further = F.filter("items", lambda x: x > F.element_at("own", -1))
        held = durable(kept.select("items", "n", "b", "own", F.explode(further).alias("item")).select("items", "n", "b", F.concat("own", F.array("item")).alias("own")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(antecedent, confidence) rules of items from rows (url, bad), and (token, item); of fewer than `least` labelled URLs none can be mined. `most` chooses the way of the search, not its result."""
    rows = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    rows = durable(rows.select("url", tokens(F.col("url")).alias("tokens"), "bad").where(F.size("tokens") > 0))
    floor = max(1, math.ceil(max(support * rows.count(), least) - 1e-9))
    items = durable(items_of(rows, floor))
    sure = items.where("share = 1").select(F.array("item").alias("antecedent"), F.col("share").alias("confidence")).distinct()
    held = rows.select("url", "bad", F.explode("tokens").alias("token")).join(items.where("share < 1"), "token")
    urls = durable(held.groupBy("url", "bad").agg(F.array_sort(F.collect_set("item")).alias("items")).select("items", "bad"))
    widest = urls.agg(F.max(F.size("items"))).first()[0] or 0
    search = grown if widest > most else frequent
    rules = durable(search(urls, floor, confidence).unionByName(sure))
    # a rule goes if another holds a part of its items with no less confidence; parts share the rule's items one by one
    parts = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"), F.element_at("antecedent", 1).alias("item"))
    whole = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item"))
    covered = whole.join(parts, "item").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
    return rules.join(covered.select("antecedent").distinct(), "antecedent", "left_anti").select("antecedent", "confidence"), items.select("token", "item")


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(item, antecedent, confidence): each rule under the item of it that fewest `urls` (column items) hold."""
    wanted = rules.select(F.explode("antecedent").alias("item")).distinct()
    counts = urls.select(F.explode("items").alias("item")).join(wanted, "item", "left_semi").groupBy("item").count()
    by = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(counts, "item", "left")
    return by.groupBy("antecedent", "confidence").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.col("item"))).alias("least")).select(F.col("least.item").alias("item"), "antecedent", "confidence")


def matched(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct `urls` (column url) that hold a token of each item of a rule: the best rule's."""
    wanted = items.join(rules.select(F.explode("antecedent").alias("item")).distinct(), "item", "left_semi")
    tokened = urls.select("url").where("url is not null").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    held = tokened.join(wanted, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    found = held.select("url", "items", F.explode("items").alias("item")).join(index(rules, held), "item")
    return found.where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, confidence (of the association rule that blocks it, else null)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), fixed.alias("fixed"))
    mined, items = mine(labelled, support, confidence, least)
    hits = matched(rows.where("rule is null").select("url"), durable(mined), items)
    joined = rows.join(hits, "url", "left").withColumn("confidence", F.when(F.col("rule").isNull(), F.col("confidence")))
    verdict = F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): a page shows the document whose number ends its path; it is bad if that one is labelled toxic or of low quality."""
    _, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(number as bigint)")
    shown = pages.select("url", F.regexp_extract(path, "/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1).alias("number")).select("url", number.alias("doc_id")).where("doc_id is not null")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return shown.join(known, "doc_id").select("url", "bad")
