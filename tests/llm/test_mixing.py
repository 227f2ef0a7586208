import hashlib
import math
import re

import pytest

from sortilex.llm.mixing import CAP, WEIGHTS, mix, repeat_copies


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(words):
    """Water-filling round by round."""
    names = sorted((s for s in words if s is not None)) + [s for s in words if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(words.values())
    while True:
        scale = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * scale > CAP * words[s]}
        if not over:
            return target | {s: weight[s] * scale for s in free}
        for s in over:
            target[s] = float(CAP * words[s])
            left -= CAP * words[s]
        free -= over


def brute_taken(group, target, total):
    """{(id, size): copies} of one source."""
    r = target / total if total else 0.0
    certain = CAP if abs(r - CAP) < 1e-12 else math.floor(r)
    f = 0.0 if certain == CAP else r - certain
    tilt = lambda n: math.floor(1000 * n / (n + 400))
    mean = sum(n * tilt(n) for _, n in group) / total if total else 0
    keys = {}
    for i, n in group:
        u = (int(hashlib.md5(f"mix-1|{'' if i is None else i}|{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        p = f + f * (1 - f) * (tilt(n) - mean) / 1000
        key = (u / (1 - u)) / (p / (1 - p)) if f > 0 else 0
        keys.setdefault((key, "" if i is None else str(i), n), []).append((i, n))
    out, before, rest = {}, 0, target - certain * total
    for key, members in sorted(keys.items()):
        words = sum(n for _, n in members)
        drawn = f > 0 and 2 * before + words <= 2 * rest
        before += words
        out |= {m: certain + drawn for m in members}
    return out


def test_matches_brute_force(docs, rows):
    words, groups = {}, {}
    for i, t, _, s, _ in rows:
        words[s] = words.get(s, 0) + sizes(t)
        groups.setdefault(s, []).append((i, sizes(t)))
    target = brute_targets(words)
    for r in mix(docs, ("doc_id", "source", "text")).collect():
        want = brute_taken(groups[r.source], target[r.source], words[r.source])
        assert (r.size, r.source_size) == (sizes(r.text), words[r.source]) and abs(r.target - target[r.source]) < 1e-6
        if r.size:
            assert r.copies == want[(r.doc_id, r.size)]
        assert r.taken == r.copies * r.size <= CAP * r.size


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_near_targets_and_repeatable(spark, sf):
    from sortilex.llm.queries import op5_mixing

    rows = op5_mixing(spark, sf).collect()
    assert sorted(rows) == sorted(op5_mixing(spark, sf).collect())
    by = {}
    for r in rows:
        taken, biggest = by.get((r.source_size, r.target), (0, 0))
        by[r.source_size, r.target] = (taken + r.taken, max(biggest, r.size))
    assert all(abs(taken - target) <= biggest for (_, target), (taken, biggest) in by.items())


def test_odd_tables(docs, clashing, empty):
    assert mix(empty).count() == 0
    wide = mix(clashing, tuple(clashing.columns))
    assert wide.columns.count("size") == 1 and wide.count() == docs.count()
    assert repeat_copies(wide).count() == sum(r.copies for r in wide.collect())
    assert mix(docs.where("text is null")).first().taken == 0


def test_ids_stay_as_they_are(spark):
    rows = [("", "a b", "s"), (None, "a b c", "s"), ("x", "d", "t")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    for keep in (("doc_id",), ("doc_id", "source")):
        assert sorted((str(r.doc_id), r.size) for r in mix(df, keep).collect()) == [("", 2), ("None", 3), ("x", 1)]
