"""URL filters: rules first, and a logistic regression on hashed character n-grams for what no rule fits.

All of it is DataFrame expressions. Host and path each give their n-grams of 3 and 4 characters (with marks at both
ends), hashed into ``buckets`` features; a URL's different features have equal weight and length 1 together. The model is
trained from a small table of labelled URLs (the one in url_labels, unless another is given), at most ``train_rows`` of each
label (those whose hash is smallest), by gradient steps with momentum: each step is one aggregation, whose result is at most
one number for each feature. Residuals are summed as whole billionths, so a rerun gives the same weights.

Edge cases. Null, or no ``://``: host and path are empty, and the method judges them. No labelled rows: all weights are 0,
the score is 0.5 and the verdict allow. Repeated URLs train once, and each row is judged. Very long URLs take time in
proportion to their length. Empty table: empty result. A kept column named like a result column is replaced by the result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_labels
from .common import LOWER, UPPER, materialize

SIZES, BUCKETS, TRAIN_ROWS = (3, 4), 2048, 1000
STEPS, RATE, MOMENTUM, DECAY = 25, 4.0, 0.9, 1e-4
RESULT = ("host", "path", "rule", "verdict", "score")


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Different hashed n-grams; characters are looked up in an array, so the time is linear in the length."""

    def of_size(chars: Column, tag: str, n: int) -> Column:
        def hashed(i: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(tag), F.lit(n), *[F.get(chars, i + k) for k in range(n)]), F.lit(buckets)).cast("int")

        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) >= n, F.transform(starts, hashed)).otherwise(F.array().cast("array<int>"))

    def grams(text: Column, tag: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        # One element, so that the characters are a variable and not an expression made anew for each n-gram.
        return F.transform(F.array(chars), lambda c: F.concat(*[of_size(c, tag, n) for n in SIZES]))[0]

    return F.array_distinct(F.concat(grams(host, "host"), grams(path, "path")))


def _logit(model: UrlModel, feats: Column) -> Column:
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    total = F.aggregate(feats, F.lit(0.0), lambda acc, f: acc + F.get(weights, f))
    return F.lit(model.bias) + F.when(F.size(feats) > 0, total / F.sqrt(F.size(feats).cast("double"))).otherwise(0.0)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS, steps: int = STEPS) -> UrlModel:
    """A model from rows of host, path and blocked (boolean)."""
    different = labelled.select("host", "path", "blocked").distinct()
    order = (F.xxhash64("host", "path"), F.col("host"), F.col("path"))
    small = different.where("blocked").orderBy(*order).limit(train_rows).unionByName(different.where("not blocked").orderBy(*order).limit(train_rows))
    rows = materialize(small.select(features(F.col("host"), F.col("path"), buckets).alias("feats"), F.col("blocked").cast("double").alias("y")).coalesce(1), "url-train").coalesce(1)
    n = rows.count()
    bias, speed_b, weights, speed = 0.0, 0.0, [0.0] * buckets, [0.0] * buckets
    unit = 1e9
    for _ in range(steps if n else 0):
        ahead = UrlModel(bias + MOMENTUM * speed_b, tuple(w + MOMENTUM * s for w, s in zip(weights, speed, strict=True)))
        residual = F.col("y") - 1 / (1 + F.exp(-_logit(ahead, F.col("feats"))))
        left = rows.select("feats", residual.alias("r"))
        each = left.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("feats"))).alias("f"), "r", F.sqrt(F.size("feats").cast("double")).alias("norm"))
        share = F.round(unit * F.when(F.col("f") < 0, F.col("r")).otherwise(F.col("r") / F.col("norm"))).cast("bigint")
        gradient = {f: s / unit / n for f, s in each.groupBy("f").agg(F.sum(share)).collect()}
        speed_b = MOMENTUM * speed_b + RATE * gradient.get(-1, 0.0)
        bias += speed_b
        speed = [MOMENTUM * s + RATE * (gradient.get(i, 0.0) - DECAY * w) for i, (s, w) in enumerate(zip(speed, ahead.weights, strict=True))]
        weights = [w + s for w, s in zip(weights, speed, strict=True)]
    return UrlModel(bias, tuple(weights))


def probability(model: UrlModel, host: Column, path: Column) -> Column:
    """That the model blocks, for columns that already hold host and path."""
    return 1 / (1 + F.exp(-_logit(model, features(host, path, len(model.weights)))))


def split_url(labelled: DataFrame, url_col: str = "url") -> DataFrame:
    """host, path and the other columns of labelled URLs."""
    url = F.col(url_col)
    return labelled.select(F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), *(c for c in labelled.columns if c != url_col))


def default_labels(spark: SparkSession) -> DataFrame:
    """The labelled table as url and blocked."""
    return spark.createDataFrame(url_labels.rows(), "url string, blocked boolean")


def filter_urls(pages: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("page_id",), url_col: str = "url", model: UrlModel | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``keep``, host, path, rule, verdict and score; without a model, one is trained from ``labelled`` (url, blocked)."""
    url = F.col(url_col)
    keep = tuple(c for c in keep if c not in RESULT)
    parts = pages.select(F.struct(*keep).alias("__row"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    parts = parts.withColumn("found", rule_for(rules, F.col("host"), F.col("path")))
    if model is None:
        model = train(split_url(default_labels(pages.sparkSession) if labelled is None else labelled))
    score = F.when(F.col("found").isNull(), probability(model, F.col("host"), F.col("path")))
    judged = parts.withColumn("p", score)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("p") > 0.5, "block").otherwise("allow"))
    certain = F.when(F.col("found.verdict") == "block", 1.0).otherwise(0.0)
    return judged.select("__row.*", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("p", certain).alias("score"))
