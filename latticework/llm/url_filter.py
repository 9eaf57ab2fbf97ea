"""URL filtering: host and path rules, and for the urls that no rule fits a logistic regression on hashed n-grams.

The model learns from a small labelled table of urls: those of the input that a rule decides, with the rule's verdict
as label, at most TRAIN_URLS of them. Its weights, of fixed number, are summed up by Spark in whole
numbers at each step, so that a rerun learns the same model, and are part of the scoring expression as one constant.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import stored

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled urls at most, n-gram lengths, weights, and the descent.
TRAIN_URLS, GRAMS, BUCKETS, STEPS, RATE, DECAY = 4000, (3, 4), 4096, 25, 24.0, 1e-4
FIXED = 1 << 30


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> Column:
    """struct(host, path), both empty where url is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.struct(lower_ascii(host).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(host: Column, path: Column) -> Column:
    """Buckets of the url's n-grams, with repeats."""
    whole = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(whole, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[grams(n) for n in GRAMS])


def chance(buckets: Column, weights: list[float], bias: float) -> Column:
    """The chance of block: the mean weight of the n-grams, scaled as a vector of length one, through a sigmoid."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(w, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(buckets)) + bias)))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias for rows (buckets, label 0 or 1). Without both labels the weights are zero."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    weights, bias = [0.0] * BUCKETS, 0.0 if not n else math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return weights, bias
    for _ in range(STEPS):
        miss = labelled.select((F.col("label") - chance(F.col("buckets"), weights, bias)).alias("miss"), F.sqrt(F.size("buckets")).alias("norm"), "buckets")
        each = miss.select("miss", "norm", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"))
        step = each.select("bucket", (F.col("miss") * FIXED / F.when(F.col("bucket") < 0, 1.0).otherwise(F.col("norm"))).cast("long").alias("g"))
        # At most BUCKETS + 1 sums reach the driver.
        for bucket, g in step.groupBy("bucket").agg(F.sum("g")).collect():
            if bucket < 0:
                bias += RATE / 8 * g / FIXED / n
            else:
                weights[bucket] += RATE * g / FIXED / n
        weights = [w * (1 - RATE * DECAY) for w in weights]
    return weights, bias


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: tuple[tuple[str, str], ...] = RULES, train_urls: int = TRAIN_URLS) -> DataFrame:
    """(id, host, path, rule, verdict, chance) for each row of pages; chance is that of block, null under a rule.

    A null url, or one without ://, has an empty host and path, which no rule fits, so the model judges it like any
    other. Each row is judged alone; repeated rows count once as labels. An empty table gives no rows.
    """
    parts = host_and_path(F.col(f"`{url_column}`"))
    urls = pages.select(F.col(f"`{id_column}`").alias(id_column), parts.alias("u")).select(id_column, "u.host", "u.path")
    judged = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    known = judged.filter("r is not null").select("host", "path", (F.col("r.verdict") == "block").cast("int").alias("label")).distinct()
    small = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(train_urls)
    labelled = stored(small.select(features(F.col("host"), F.col("path")).alias("buckets"), "label").coalesce(1), "labelled-urls")
    weights, bias = train(labelled)
    p = F.when(F.col("r").isNull(), chance(features(F.col("host"), F.col("path")), weights, bias))
    scored = judged.withColumn("chance", p)
    return scored.select(id_column, "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("chance") >= 0.5, "block").otherwise("allow")).alias("verdict"), "chance")
