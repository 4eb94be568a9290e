"""URL filters: listed host and path rules, then association rules that FP-growth mines from labelled URLs.

A URL's items are its host labels (`h:`), its path segments (`p:`, digits as `#`) and its query keys (`q:`). Over the
labelled URLs, each with an item for its label, FP-growth finds the item combinations whose support and confidence of
blocking are high enough, counted in rows. A rule is posted in an inverted index under its rarest item; a URL meets the
rules posted under its own items and is blocked if it has all items of one of them. URLs of equal items are judged once.

Everything runs as DataFrame and SQL functions and Spark ML's own FP-growth.

Defined results: null or no `://` gives an empty host and path; such a URL has no items and is allowed; with no labels
or no rule that passes, whatever no listed rule covers is allowed; repeated rows are judged alike; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_SUPPORT = 0.0005
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
SALTS = 64


def _rest(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the listed (verdict, host, path) rules that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def items(url: Column, host_col: Column, path_col: Column) -> Column:
    """The sorted distinct items of a URL."""
    labels = F.transform(F.split(host_col, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path_col, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments, keys), lambda x: F.length(x) > 2)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """From rows (items, blocked): rule_id, antecedent, rarest (its least frequent item), support, confidence.

    A rule's count is that of blocked rows with all its items; it needs max(min_count, n * min_support) of the n labelled
    rows; its support is count / n. FP-growth sees only items that are frequent together with a blocked URL; no rule can
    hold any other. Items of exactly the same rows are mined as one, so that keys which always come together don't make a
    rule for each subset; a rule names the first of them and fits whatever has any. Second: (item, head) of all such items.
    """
    spark = labelled.sparkSession
    labelled = materialise(labelled.filter(F.col("blocked").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "labelled")
    n = labelled.count()
    least = max(min_count, math.ceil(n * min_support - 1e-9))
    met = labelled.select("row", "blocked", F.explode("items").alias("item"))
    mark = F.xxhash64("row").cast("decimal(38,0)")
    counts = met.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("bad"), F.sum(mark).alias("same"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("as"), F.min("row").alias("low"), F.max("row").alias("high")
    )
    counts = counts.filter(F.col("bad") >= least)
    # items of equal rows: one of them stands for all
    twins = counts.groupBy("n", "bad", "same", "as", "low", "high").agg(F.min("item").alias("head"), F.array_sort(F.collect_list("item")).alias("all"))
    twins = materialise(twins.select("head", "n", F.explode("all").alias("item")), "items")
    heads = twins.filter("item = head").select("head", "n")
    kept = met.join(heads.select(F.col("head").alias("item")), "item").groupBy("row", "blocked").agg(F.collect_list("item").alias("have"))
    baskets = kept.select(F.concat("have", F.when(F.col("blocked"), F.array(F.lit("!"))).otherwise(F.array().cast("array<string>"))).alias("basket"))
    baskets = materialise(baskets, "baskets")
    size = baskets.count()
    if size == 0:
        return spark.createDataFrame([], "rule_id long, antecedent array<string>, rarest string, support double, confidence double"), twins.select("item", "head")
    # half a row less than `least`, as the share is rounded on its way to a count
    model = FPGrowth(itemsCol="basket", minSupport=(least - 0.5) / size, minConfidence=0.0).fit(baskets)
    sets = materialise(model.freqItemsets.select(F.array_sort(F.array_remove("items", "!")).alias("heads"), F.array_contains("items", "!").alias("bad"), "freq"), "sets")
    every = sets.filter("NOT bad").select("heads", F.col("freq").alias("of"))
    found = sets.filter(F.col("bad") & (F.size("heads") > 0) & (F.col("freq") >= least)).join(every, "heads")
    found = found.filter(F.col("freq") >= min_confidence * F.col("of")).select(F.col("heads").alias("antecedent"), (F.col("freq") / n).alias("support"), (F.col("freq") / F.col("of")).alias("confidence"))
    rarest = found.select("antecedent", F.explode("antecedent").alias("head")).join(heads, "head").groupBy("antecedent").agg(F.min(F.struct("n", "head"))["head"].alias("rarest"))
    rules = found.join(rarest, "antecedent").select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "rarest", "support", "confidence")
    return materialise(rules, "rules"), twins.select("item", "head")


def match(urls: DataFrame, rules: DataFrame, twins: DataFrame, key: str = "items") -> DataFrame:
    """For each distinct item set of `urls` that a rule fits: the items and the best rule (by confidence, support, items)."""
    sets = urls.select(key).distinct()
    known = sets.select(key, F.explode(key).alias("item")).join(twins, "item").groupBy(key).agg(F.collect_set("head").alias("heads"))
    met = known.select(key, "heads", F.explode("heads").alias("rarest")).join(rules, "rarest").filter(F.size(F.array_except("antecedent", "heads")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("text"), "antecedent"))
    return met.groupBy(key).agg(best.alias("best")).select(key, F.col("best.antecedent").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, mined (the items of the association rule that blocks), confidence.

    labels: (id, blocked) of some pages.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    p = p.withColumn("host", host(F.col("u"))).withColumn("path", path(F.col("u")))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    p = p.select("id", "host", "path", rule.alias("rule"), verdict.alias("listed"), items(F.col("u"), F.col("host"), F.col("path")).alias("items"))
    p = materialise(p.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))), "urls")
    marks = labels.select(F.col(id_col).alias("id"), "blocked").groupBy("id").agg(F.max("blocked").alias("blocked"))
    best = match(p.filter("rule IS NULL"), *mine(p.join(marks, "id").select("items", "blocked")))
    # one item set may be that of a third of all pages, so its verdict goes to SALTS places
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = best.select(F.col("items").alias("have"), "mined", "confidence", salt.alias("salt"))
    own = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    out = p.join(spread, (F.col("items") == F.col("have")) & (own == F.col("salt")) & F.col("rule").isNull(), "left")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.array_join("mined", " ").alias("mined"),
        "confidence",
    )
