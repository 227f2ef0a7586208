import random

import numpy as np
import pytest

from sortilex.llm.components import components, union_find
from sortilex.llm.near_dup import candidates, near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    """Number of shingles and component of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(pairs)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root.get(i, i), []).append(d)
    least = {g: min((d for d in own if d is not None), default=None) for g, own in groups.items()}
    return [(d, len(s), least[root.get(i, i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.fixture(scope="module")
def texts():
    """Families of edited copies around originals, of mixed sizes, and unrelated texts with a common passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(20))
    out = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([1, 3, 40]) if family else 120):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 50)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [passage + " " + " ".join(word() for _ in range(rng.randint(0, 15))) for _ in range(150)]
    out += ["one two", "One  two", "one two three", "", None, " \n "]
    rng.shuffle(out)
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("options", [{}, {"family_shingles": 500, "block_shingles": 900, "broadcast_rows": 0}])
@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, texts, percent, options):
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, percent, **options).collect())
    assert got == sorted(brute(texts, percent))


def test_odd_rows(docs, rows, clashing, empty):
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = sorted(brute([r[:2] for r in rows], 85), key=key)
    for df in (docs, clashing):
        out = near_duplicates(df, 85)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=key) == want
        assert out.where("not kept").count() == sum(d != c for d, _, c in want)
    assert near_duplicates(empty, 85).count() == 0
    assert near_duplicates(docs.where("text is null"), 85).first().kept


@pytest.mark.parametrize("local_edges", [0, 10, 1000])
def test_components(spark, local_edges):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(30)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [*chain, *star, *loose, (300, 300), (5, 6)]
    rng.shuffle(pairs)
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint"), local_edges).collect()
    want = union_find([p for p in pairs if p[0] != p[1]])
    groups, ours = {}, {}
    for n, r in want.items():
        groups.setdefault(r, set()).add(n)
    for r in found:
        ours.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))
    assert components(spark.createDataFrame([], "a bigint, b bigint"), local_edges).count() == 0


def test_candidates_by_the_whole_signature(spark):
    a = np.arange(128, dtype=np.uint32)
    near, far = a.copy(), a + 128
    near[:28] += 1  # 36 of the first 64 places agree, and 100 of all
    rows = [(c, bytearray(x.tobytes())) for c, x in ((b"a", a), (b"b", near), (b"c", far))]
    found = candidates(spark.createDataFrame(rows, "cls binary, sig binary")).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in found] == [(b"a", b"b")]


def test_null_and_repeated_ids_do_not_multiply(spark, monkeypatch):
    """Rows that reach the family tasks are classes, however many rows have no id, or share one."""
    from sortilex.llm import near_dup

    met = []
    real = near_dup._small_families
    monkeypatch.setattr(near_dup, "_small_families", lambda members, percent: met.append(members.count()) or real(members, percent))
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(60)] for _ in range(40)]
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(b)) for b in base for _ in range(5)] + [(None, near(b)) for b in base for _ in range(5)]
    rows += [(7, " ".join(f"v{i}" for i in range(60)))] * 3000 + [(8, near([f"v{i}" for i in range(60)]))]
    rows += [(9, " ".join(f"u{k} x{i}" for i in range(40))) for k in range(30)] + [(9, near([f"u{k} x{i}" for i in range(40)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 85).collect()), key=str)
    assert met == [80 + 2 + 60]
    small = [r for r in rows if r[0] != 7] + [rows[400]]
    want = sorted(brute(small, 85), key=str)
    assert [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7] and sum(g == (7, 56, 7) for g in got) == 3000
    monkeypatch.setattr(near_dup, "HOT_SHARE", 2.0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 85).collect()), key=str) == got


def test_intermediate_tables_go(spark, texts, tmp_path, monkeypatch):
    from sortilex.sources import storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    near_duplicates(spark.createDataFrame(texts[:100], "doc_id bigint, text string"), 85).count()
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"dedup-signed", "dedup-classes", "dedup-roots"}
