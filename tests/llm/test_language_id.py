import numpy as np
from pyspark.sql import functions as F

from sortilex.llm.language_id import DIM, Profiles, predict, train


def brute_vector(text, p):
    """Bundle of bound trigrams, one at a time."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    v = np.zeros(DIM, np.int64)
    for word in letters.split():
        w = f" {word} "
        for i in range(len(w) - 2):
            a, b, c = (p.letter(ord(x)).astype(np.int64) for x in w[i : i + 3])
            v += np.roll(a, 2) * np.roll(b, 1) * c
    return v


def test_bundles_match_brute_force(rows):
    p = Profiles()
    texts = [t or "" for _, t, *_ in rows if len(t or "") < 5000]
    owner, codes = p.trigrams(texts)
    for text, got in zip(texts, p.bundle(owner, codes, len(texts)), strict=True):
        assert (got == brute_vector(text, p)).all()


def test_prototypes_and_cosines(spark, docs, rows):
    p = Profiles()
    sums = {}
    for _, t, lang, *_ in rows:
        if lang and t:
            sums[lang] = sums.get(lang, 0) + brute_vector(t, p)
    got = train(docs)
    assert got.keys() == sums.keys() and all((got[k] == sums[k]).all() for k in sums)
    out = {r.text: (r.lang_pred, r.score) for r in predict(docs, got, ("text",)).collect()}
    for _, t, *_ in rows:
        v = brute_vector(t or "", p)
        if not any(c.isalpha() for c in t or ""):
            assert out[t] == ("und", 0.0)
        else:
            cos = {k: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for k, s in sums.items()}
            assert abs(max(cos.values()) - out[t][1]) < 1e-8 and cos[out[t][0]] > max(cos.values()) - 1e-8


def test_more_languages_than_a_block(spark, docs, rows, monkeypatch):
    more = docs.withColumn("lang", F.coalesce(F.concat("lang", (F.col("doc_id") % 5).cast("string")), F.col("lang")))
    whole = train(more)
    assert len(whole) > 5
    want = sorted(map(str, predict(docs, whole, ("doc_id", "text")).collect()))
    monkeypatch.setattr("sortilex.llm.language_id.BLOCK_LANGUAGES", 3)
    table = train(more)
    assert not isinstance(table, dict) and table.count() == len(whole)
    for size in (1, 3):
        assert sorted(map(str, predict(docs, table, ("doc_id", "text"), block_languages=size).collect())) == want
    assert sorted(r.lang_pred for r in predict(docs, table, block_languages=2).collect()) == sorted(r.lang_pred for r in predict(docs, whole).collect())


def test_odd_tables(docs, clashing, empty):
    prototypes = train(docs)
    assert predict(empty, prototypes).count() == 0
    assert train(empty) == {} and train(docs.where("lang is null")) == {}
    assert {(r.lang_pred, r.score) for r in predict(docs, {}).collect()} == {("und", 0.0)}
    wide = predict(clashing, prototypes, tuple(clashing.columns))
    assert wide.columns.count("score") == 1 and dict(wide.dtypes)["score"] == "double" and wide.count() == docs.count()


def test_held_out_accuracy(spark):
    from sortilex.llm.queries import op10_language_id

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op10_language_id(spark, sf).join(labels, "doc_id").where("held_out and lang_pred != 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
