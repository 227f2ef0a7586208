import zlib

import numpy as np
import pytest
import test_decontaminate
import test_language_id
import test_mixing
import test_near_dup

import corpus_pipeline as cp
from sortilex.llm.language_id import Profiles
from sortilex.llm.queries import op1_decontaminate, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("stage", cp.STAGES, ids=[s[0] for s in cp.STAGES])
def test_stages_take_odd_tables(spark, sf, docs, clashing, empty, stage):
    name, f = stage
    for df in (docs, empty, docs.where("text is null"), clashing):
        out = f(spark, df, sf)
        assert out.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "token_files" else df.columns)
        out.collect()
    if name != "token_files":
        own = {r.doc_id: r for r in clashing.collect()}
        assert all(tuple(r) == tuple(own[r.doc_id]) or r.doc_id in (None, 106) for r in f(spark, clashing, sf).collect())


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, f in cp.STAGES[:3]:
        kept = f(spark, kept, sf).cache()
    ids = {r.doc_id for r in kept.collect()}
    leaked = {r.doc_id for r in op1_decontaminate(spark, sf).where("n_hit >= 8").collect()}
    assert leaked and not leaked & ids and len(ids) > 0.7 * docs.count()
    assert kept.groupBy("text").count().where("count > 1").isEmpty()
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= ids
    assert sorted(r.start for r in out)[0] == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_foreign_and_short_texts(spark, sf):
    rows = [(1, "Re.", "en", "s", 3), (2, "123 !!!", "en", "s", 7), (3, "日本語の文章です。" * 20, "en", "s", 9), (4, "the river and the tree were there with the others in the evening " * 3, "en", "s", 9)]
    out = cp.language_id(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").where("doc_id != 3").unionByName(spark.createDataFrame([(3, rows[2][1], None, "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")), sf)
    assert {r.doc_id for r in out.collect()} == {1, 4}


def test_near_dup_decides_by_row(spark, sf):
    same, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59))
    clean, other, none = (" ".join(f"{c}{i}" for i in range(60)) for c in "bcd")
    rows = [(1, same), (2, near), (2, clean), (3, other), (3, other), (None, none), (None, none), (None, same), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, cp.near_dup(spark, df, sf).collect()), key=key) == sorted([(1, same), (2, clean), (3, other), (None, none), (4, None), (4, None)], key=key)


def test_every_stage_matches_brute_force(spark, tmp_path):
    """Each stage on its input, from definitions: trigrams, all pairs, windows, targets, the tokenizer library."""
    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500 OR text IS NULL")
    odd = [(9001, "日本語の文章です。" * 20, None, "s", 9), (9002, "123 !!!", "en", "s", 7), (9003, None, "en", "s", 0), (9004, "Re.", "en", None, 3)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).cache()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]

    p, sums = Profiles(), {}
    vector = {r[0]: test_language_id.brute_vector(r[1] or "", p) for r in rows}
    for i, text, lang, _ in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector[i]
    cosine = {i: max(v @ s / np.linalg.norm(v) / np.linalg.norm(s) for s in sums.values()) if v.any() else 0 for i, v in vector.items()}
    letters = {r[0]: sum(c.isalpha() for c in r[1] or "") for r in rows}
    kept = [r for r in rows if letters[r[0]] and not (letters[r[0]] >= cp.LEAST_LETTERS and cosine[r[0]] < cp.LEAST_SCORE)]
    stage = dict(cp.STAGES)
    docs = stage["language_id"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept) and 9004 in {r[0] for r in kept} and 9001 not in {r[0] for r in kept}

    found = test_near_dup.brute([(r[0], r[1]) for r in kept], cp.SIMILAR)
    kept = [r for r, (i, n, component) in zip(kept, found, strict=True) if i == component]
    docs = stage["near_dup"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [x for x in items if len(test_decontaminate.WORD.findall(x[1] or "")) < cp.WINDOW]
    long = [x for x in items if x not in short]
    leaks = lambda t: len(test_decontaminate.brute(t, items)[2]) >= 2 or bool(test_decontaminate.brute(t, long)[1]) or test_decontaminate.brute(t, short)[1] >= cp.WINDOW
    kept = [r for r in kept if not leaks(r[1])]
    docs = stage["decontamination"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept)

    words, groups = {}, {}
    for i, t, _, s in kept:
        words[s] = words.get(s, 0) + test_mixing.sizes(t)
        groups.setdefault(s, []).append((i, test_mixing.sizes(t)))
    target = test_mixing.brute_targets(words)
    copies = {s: test_mixing.brute_taken(own, target[s], words[s]) for s, own in groups.items()}
    kept = [r for r in kept for _ in range(copies[r[3]][r[0], test_mixing.sizes(r[1])])]
    docs = stage["mixing"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept)

    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t, *_ in sorted(kept, key=lambda r: r[0]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stage["token_files"](spark, docs, sf).collect()) == want
