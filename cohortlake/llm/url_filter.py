"""URL filtering by host rules and by association rules mined with FP-growth."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    after = F.when(url.contains("://"), url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits is the longest
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct items of a url: scheme, host, its suffixes, path words with digits folded, query keys."""
    host, path = host_and_path(url)
    parts = F.split(host, r"\.")
    words = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "[/.]"), lambda w: w != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda w: w != "")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.coalesce(F.substring_index(url, "://", 1), F.lit(""))), F.concat(F.lit("host:"), host)),
            F.transform(parts, lambda w: F.concat(F.lit("label:"), w)),
            F.transform(words, lambda w: F.concat(F.lit("path:"), w)),
            F.transform(query, lambda w: F.concat(F.lit("query:"), F.substring_index(w, "=", 1))),
        )
    )


def mine(urls: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_urls: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rules: rule_items, support, confidence; names: token, item) of ``urls`` (url, bad).

    Rules are the least combinations of items whose urls are bad with at least the
    confidence, on ``min_urls`` bad urls at least; no rows mine no rules; null
    urls are left out and null labels count as good. Tokens that stand in
    exactly the same labelled urls are one item (any of them stands for it), so
    a host and its labels, or the words of a url that comes many times, do not
    multiply. Nothing is cut: items on too few bad urls can be in no rule; an
    item that is a rule by itself, or stands in every url, is in no longer rule
    that is needed. The others are mined by FP-growth in the bad urls alone, where
    all combinations that may be rules occur, and counted in all urls.
    """
    spark = urls.sparkSession
    rows = urls.where("url is not null").select("url", F.coalesce("bad", F.lit(False)).alias("bad"), F.monotonically_increasing_id().alias("row"))
    total, bad_total = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    least = max(min_urls, math.ceil(min_support * total - 1e-9))
    names = "token string, item string"
    if bad_total < least:
        return spark.createDataFrame([], "rule_items array<string>, support double, confidence double"), spark.createDataFrame([], names)
    exploded = rows.select("row", "bad", "url", F.explode(tokens(F.col("url"))).alias("token"))
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 31))).alias(f"s{seed}")
    seen = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("hits"), mark(1), mark(2)).where(F.col("hits") >= least)
    same = Window.partitionBy("n", "hits", "s1", "s2")  # few tokens are on so many bad urls: tokens per url / support at most
    known = seen.select("token", F.min("token").over(same).alias("item"), "n", "hits")
    sure = F.col("hits") >= min_confidence * F.col("n")
    alone = known.where(sure & (F.col("token") == F.col("item"))).select(F.array("item").alias("rule_items"), "n", "hits")
    open_ = known.where(~sure & (F.col("n") < total)).select("token", "item")
    bags = exploded.join(open_, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_set("item")).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("hits"))
    baskets = bags.where("hits > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("hits"))))
    n_baskets = baskets.count()
    if n_baskets >= least:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_baskets * (1 - 1e-9))).fit(baskets).freqItemsets
        several = found.where(F.size("items") > 1).select(F.array_sort("items").alias("rule_items"), F.col("freq").alias("hits"))
        sizes = bags.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
        spread = several.select("rule_items", "hits", F.explode("rule_items").alias("item")).join(sizes, "item")
        posted = spread.groupBy("rule_items").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.max("hits").alias("hits"))
        held = bags.select("items", "n", F.explode("items").alias("item")).join(posted, "item").where(F.size(F.array_except("rule_items", "items")) == 0)
        counted = held.groupBy("rule_items").agg(F.sum("n").alias("n"), F.max("hits").alias("hits"))
        alone = alone.unionByName(counted.where(sure))
    good = alone
    # a rule that stays when one of its items goes is not needed
    less = good.select("rule_items", F.explode("rule_items").alias("item")).select("rule_items", F.array_remove("rule_items", F.col("item")).alias("shorter"))
    longer = less.join(good.select(F.col("rule_items").alias("shorter")), "shorter").select("rule_items").distinct()
    kept = good.join(longer, "rule_items", "left_anti")
    return kept.select("rule_items", (F.col("hits") / F.lit(total)).alias("support"), (F.col("hits") / F.col("n")).alias("confidence")), known.select("token", "item")


def matched(urls: DataFrame, rules: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct urls of ``urls`` (url) that hold all items of some rule: each rule
    is posted once, under its rarest item, and checked whole where that item stands."""
    held = urls.where("url is not null").select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token")).join(names, "token")
    bags = scratch.table(held.groupBy("url").agg(F.collect_set("item").alias("bag")))
    spread = rules.select("rule_items", F.explode("rule_items").alias("item"))
    sizes = bags.select(F.explode("bag").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    index = spread.join(sizes, "item").groupBy("rule_items").agg(F.min_by("item", F.struct("n", "item")).alias("item"), F.count(F.lit(1)).alias("known")).where("known = size(rule_items)")
    index = scratch.table(index.select("item", "rule_items"))
    return bags.select("url", "bag", F.explode("bag").alias("item")).join(index, "item").where(F.size(F.array_except("rule_items", "bag")) == 0).select("url").distinct()


def judge(pages: DataFrame, mined: tuple[DataFrame, DataFrame], scratch: Scratch, id_col: str = "page_id", url_col: str = "url", host_rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row. A host rule
    decides where one fits; elsewhere a url that holds a mined rule is blocked,
    and the rest, null urls included, is allowed. Ids are only carried, repeated
    rows get equal verdicts. mined: see ``mine``."""
    mine_ = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    rules, names = (scratch.table(x) for x in mined)
    bad = scratch.table(matched(mine_, rules, names, scratch).withColumn("bad", F.lit(True)))
    host, path = host_and_path(F.col("url"))
    named = mine_.join(bad, "url", "left").withColumns({"host": host, "path": path})
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))


def op9(spark, sf_dir: str) -> DataFrame:
    """All pages; a page is bad if its label says toxic or low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.coalesce(F.max("toxic"), F.lit(0)) > 0).alias("toxic"), F.min("quality").alias("quality"))
    known = pages.join(labels, "page_id").select("url", (F.col("toxic") | (F.coalesce("quality", F.lit(1)) < 1)).alias("bad"))
    return judge(pages, mine(known), Scratch(spark, "op9"))
