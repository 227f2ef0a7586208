import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilex.llm.common import crc_of_id
from sortilex.llm.lm_scoring import ALPHA, DISCOUNT, lm_scores


def split(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


class Brute:
    """The same model from its definition: recursive interpolation over dictionaries."""

    def __init__(self, texts, least=2):
        self.c = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.grams, self.arcs = {}, {}
        for size in (2, 3):
            seen = Counter(tuple(t[i : i + size]) for t in texts for i in range(len(t) - size + 1))
            self.grams |= {g: k for g, k in seen.items() if k >= least}
        for g in self.grams:
            self.arcs.setdefault(g[:-1], []).append(g)

    def p(self, h, w):
        if not h:
            return (self.c[w] + ALPHA) / (self.n + ALPHA * (self.v + 1))
        total = self.c[h[0]] if len(h) == 1 else self.grams.get(h, 0)
        if not total:
            return self.p(h[1:], w)
        fail = 1 - sum(self.grams[g] - DISCOUNT for g in self.arcs.get(h, ())) / total
        return max(0, self.grams.get((*h, w), 0) - DISCOUNT) / total + fail * self.p(h[1:], w)

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("options", [{}, {"least": 3, "block_bytes": 500}])
def test_matches_brute_force(docs, rows, options):
    small = [(i, t) for i, t, *_ in rows if len(t or "") < 5000]
    train = [split(t) for i, t in small if not held(i)]
    model = Brute(train, options.get("least", 2))
    out = lm_scores(docs.where("coalesce(length(text), 0) < 5000"), crc_of_id() % 10 == 0, ("doc_id", "text"), **options)
    found = out.collect()
    got = {(r.doc_id, r.text): r for r in found}
    assert len(got) == len(set(small)) and len(found) == len(small)
    for i, t in small:
        r, own = got[i, t], split(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(model.c[w] > 0 for w in own), model.n)
        assert r.base_score == pytest.approx(sum(math.log10(model.p((), w)) for w in own), rel=1e-9)
        assert r.score == pytest.approx(model.score(own), rel=1e-9)


def test_each_state_sums_to_one(rows):
    model = Brute([split(t) for _, t, *_ in rows[:30]])
    for h in [(), *list(model.arcs)[:40]]:
        unseen = ALPHA / (model.n + ALPHA * (model.v + 1))  # the share of all words never seen
        assert sum(model.p(h, w) for w in model.c) + model.p(h, b"never seen") == pytest.approx(1 if unseen else 0, rel=1e-9)


def test_better_than_the_base_on_held_out_texts(spark):
    from sortilex.llm.queries import op8_lm_scoring

    sums = op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[0] < sums[1] < 0


def test_odd_tables(docs, clashing, empty):
    assert lm_scores(empty, crc_of_id() % 10 == 0).count() == 0
    nothing = lm_scores(docs.where("doc_id < 5"), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)} and all(np.isfinite(r.score) for r in nothing)
    wide = lm_scores(clashing, crc_of_id() % 10 == 0, tuple(clashing.columns))
    assert wide.columns.count("score") == 1 and wide.count() == docs.count()


def test_rare_ngrams_count_in_a_large_table(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, 400)) for _ in range(200)] + ["one seldom phrase w1 w2", "w3 one seldom phrase"]
    asked = ["one seldom phrase", "w1 one seldom w2 phrase", "unknown seldom"]
    df = spark.createDataFrame(list(enumerate(asked + texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scores(df, F.col("doc_id") < len(asked)).where("held_out").collect()}
    model = Brute([split(t) for t in texts])
    assert (b"one", b"seldom", b"phrase") in model.grams
    for i, t in enumerate(asked):
        assert got[i].score == pytest.approx(model.score(split(t)), rel=1e-9)
