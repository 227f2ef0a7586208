import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilex.llm import url_labels
from sortilex.llm.url_filter import BUCKETS, DECAY, MOMENTUM, RATE, SIZES, STEPS, Rule, default_labels, features, filter_urls, probability, split_url, train

RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]
URLS = ["https://a.example.com/en/71?x=1", "http://Example.COM/en/6#y", "x://example.net/de/8", "x://notexample.net/de/8", "https://net/de/", "https://net/de", "https://org/es/://z", None, "", "no scheme", "://", "://?q", "http://com", "http://xcom/en/1", "a://b.com/en/" + "x" * 50_000, "https://é.org/es/ñ\nz?"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "own") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, verdict string")


def test_rules_and_parts(pages):
    out = {r.page_id: r for r in filter_urls(pages, RULES).collect()}
    for i, url in enumerate([*URLS, *URLS]):
        host, path, rule = brute(url)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule and rule.name)
        assert out[i].verdict == rule.verdict if rule else out[i].verdict in ("allow", "block")
        assert 0 <= out[i].score <= 1
    assert all(out[i][1:] == out[i + len(URLS)][1:] for i in range(len(URLS)))


def test_odd_tables(spark, pages):
    assert filter_urls(pages.limit(0), RULES).count() == 0
    none = default_labels(spark).limit(0)
    assert {(r.verdict, r.score) for r in filter_urls(pages, [], labelled=none).collect()} == {("allow", 0.5)}
    wide = filter_urls(pages.withColumn("host", F.lit("own")), RULES, ("page_id", "host", "verdict", "url"))
    assert wide.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]


def test_learns_and_repeats(spark, sf):
    """Held-out URLs that rules label get the rule's verdict from the model alone."""
    parts = filter_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), RULES).where("rule is not null").cache()
    labelled = parts.select("host", "path", (F.col("verdict") == "block").alias("blocked"), (F.abs(F.xxhash64("path")) % 4 == 0).alias("held"))
    model = train(labelled.where("not held"))
    assert train(labelled.where("not held").repartition(5)) == model
    right = labelled.where("held").agg(F.avg((F.col("blocked") == (probability(model, F.col("host"), F.col("path")) > 0.5)).cast("int"))).first()[0]
    assert right > 0.9


def test_features_are_linear_in_length_and_distinct(spark):
    row = spark.createDataFrame([("h", "/" + "ab" * 20_000)], "host string, path string").select(features(F.col("host"), F.col("path")).alias("f")).first()
    assert len(row.f) == len(set(row.f)) < 20


def dense(spark, urls):
    """Hashed n-grams of each URL, from their definition; the hash is Spark's."""
    grams = []
    for url in urls:
        host, path, _ = brute(url)
        marked = [(tag, f"^{x}$") for tag, x in (("host", host), ("path", path))]
        grams.append({(tag, n, x[i : i + n]) for tag, x in marked for n in SIZES for i in range(len(x) - n + 1)})
    every = sorted(set().union(*grams))
    hashed = {}
    for n in SIZES:
        rows = spark.createDataFrame([(t, n, g) for t, k, g in every if k == n], "t string, n int, g string")
        code = F.pmod(F.xxhash64("t", "n", *[F.substring("g", i + 1, 1) for i in range(n)]), F.lit(BUCKETS))
        hashed |= {(r.t, r.n, r.g): r.c for r in rows.withColumn("c", code).collect()}
    x = np.zeros((len(urls), BUCKETS))
    for i, own in enumerate(grams):
        x[i, [hashed[g] for g in own]] = 1
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def test_model_matches_a_dense_logistic_regression(spark):
    """Features, gradient steps and probabilities, against NumPy."""
    urls, blocked = zip(*url_labels.rows(), strict=True)
    assert len(set(urls)) == len(urls) == 160 and sum(blocked) == 80
    x, y = dense(spark, urls), np.array(blocked, float)
    w, b, vw, vb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        ahead_w, ahead_b = w + MOMENTUM * vw, b + MOMENTUM * vb
        left = y - 1 / (1 + np.exp(-(x @ ahead_w + ahead_b)))
        vw = MOMENTUM * vw + RATE * (x.T @ left / len(y) - DECAY * ahead_w)
        vb = MOMENTUM * vb + RATE * left.mean()
        w, b = w + vw, b + vb
    model = train(split_url(default_labels(spark)))
    assert np.allclose(model.weights, w, atol=1e-5) and abs(model.bias - b) < 1e-5
    asked = ["http://new-casino.example/slots/bonus", "https://en.encyclopedia.example/wiki/Stone", None]
    df = split_url(spark.createDataFrame([(u,) for u in asked], "url string"))
    got = [r[0] for r in df.select(probability(model, F.col("host"), F.col("path"))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(dense(spark, asked) @ w + b))), atol=1e-5)
    assert got[0] > 0.7 and got[1] < 0.3
    assert (np.array([r[0] for r in split_url(default_labels(spark)).select(probability(model, F.col("host"), F.col("path"))).collect()]) > 0.5).tolist() == list(blocked)
