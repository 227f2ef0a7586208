import random
import zlib

import numpy as np
import pytest

from sortilex.llm.packing import open_shard, pack, read_documents, write_shards
from sortilex.llm.pretokens import PieceEncoder, encoder
from sortilex.llm.queries import tokenizer_path
from sortilex.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_library(library):
    rng = random.Random(1)
    alphabet = ["a", "b", " ", " ", "\n", "'s", "1", "é", "<|endoftext|>", "!", "\t", "\u3000", "\x85", "word", "日"]
    e = PieceEncoder(tokenizer_path(), cache_entries=50)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        want = library(text)
        assert np.frombuffer(e.ids(text), e.dtype).tolist() == want
        assert e.count(text, {"b": 1}) == len(want)


def test_every_letter_and_mark_equals_the_library(library):
    """Each character before the first letters that aren't taken apart, and some after, in all kinds of pieces."""
    e = PieceEncoder(tokenizer_path(), cache_entries=500)
    for c in [chr(i) for i in range(0x300)] + list("ǅʰªº²½日\u2028\u0301"):
        for text in (f"x{c}y {c}", f"{c}ab {c}ab. a{c}", f"ab {c}\nab{c} ab{c}.\n{c}x", f"ab{c}\n\nq ab\n{c} z", f" ab{c}'s it{c}' 'tis"):
            want = library(text)
            assert np.frombuffer(e.ids(text), e.dtype).tolist() == want, text
            assert e.count(text, {}) == len(want)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    e, t = PieceEncoder(path), Tokenizer.from_file(path)
    assert not e.by_piece
    for text in ("The Cat's  mat, it\nis Über.", "", " x "):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.ids(text), e.dtype).tolist() == want and e.count(text, {}) == len(want)


def test_counts(spark, docs, rows, clashing, empty, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(docs, tokenizer_path()).collect())
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(library(t))) for i, t, *_ in rows)
    assert token_counts(empty, tokenizer_path()).count() == 0
    wide = token_counts(clashing, tokenizer_path(), tuple(c for c in clashing.columns if c != "__text"))
    assert dict(wide.dtypes)["n_tokens"] == "bigint" and wide.count() == len(rows)


def expected(rows, library):
    out, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library(t), 2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("options", [{"shards": 1}, {"shards": 5, "seq_len": 7}, {}])
def test_files_round_trip(spark, docs, rows, library, options):
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in pack(docs, tokenizer_path(), **options).collect()))
    want, total = expected(rows, library)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((g[1:] for g in got), key=key) == sorted(want, key=key)
    ids = [g[1] for g in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [g[0] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))] and sum(g[2] for g in got) == total


def test_rows_have_equal_length_and_masks(spark, docs, tmp_path):
    manifest = write_shards(docs, tokenizer_path(), f"file://{tmp_path}/out", seq_len=16, shards=2).orderBy("shard").collect()
    assert [m.start for m in manifest] == [0, manifest[0].n_tokens][: len(manifest)]
    for m in manifest:
        reader = open_shard(m.path)
        masks, lasts = [], []
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            assert all(len(x) == 16 for x in batch.column(0).to_pylist())
            masks += batch.column(1).flatten().to_pylist()
            lasts += batch.column(2).flatten().to_pylist()
        assert sum(masks) == m.n_tokens and sum(lasts) == m.n_docs and masks == sorted(masks, reverse=True)
        assert sum(len(ids) for _, _, ids in read_documents(m.path)) == m.n_tokens


def test_no_rows(spark, empty):
    assert pack(empty, tokenizer_path()).count() == 0


def test_queries(spark, sf, library):
    from sortilex.llm.queries import op3_token_counts, op6_token_files

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = {i: len(library(t)) for i, t in docs.items()}
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in op3_token_counts(spark, sf).collect()} == {i: (k, k > 1024) for i, k in n.items()}
    assert {r.doc_id: r.n_tokens for r in op6_token_files(spark, sf).collect()} == {i: k + 1 for i, k in n.items()}
    assert encoder(tokenizer_path()) is encoder(tokenizer_path())
