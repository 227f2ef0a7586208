import re

from sortilex.llm.licenses import ANCHORS, BASE, Signature, scan_licenses, signatures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU General Public License v3 or the MIT-License. MIT License!",
    "cc-by 4.0 and CC BY-SA 3.0; xcc by, cc  BY",
    "SPDX-License-Identifier: Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "the mit licenses; apache licence; commit license",
    "All rights reserved.",
    "MIT LICENSE " * 300,
]


def brute_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def brute_detections(text, rules):
    """All rules on all texts, without gate or marks; then pairwise containment."""
    norm = " " + " ".join(WORD.findall((text or "").translate(LOWER))) + " "
    found = [(norm.count(" ", 0, m.start()), norm.count(" ", 0, m.end()) - 1, r) for r in rules if r.keyword in norm for m in re.finditer(f" ({r.regex})(?= )", norm)]
    order = sorted(found, key=lambda d: (d[0], -d[1], d[2].level, d[2].label, d[2].weight, d[2].base))
    return [(a, b, r.label) for k, (a, b, r) in enumerate(order) if not any(x <= a and y >= b and s.level <= r.level for x, y, s in order[:k])]


def test_matches_brute_force(spark, docs, rows):
    more = [(1000 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(more, docs.schema).unionByName(docs.where("doc_id is not null"))).collect()}
    rules = signatures()
    for i, t, *_ in [*rows, *more]:
        if i is not None:
            starts = [d["first"] for d in got[i].base]
            assert (got[i].n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(got[i].base_labels)) == brute_base(t)
            assert [(d["first"], d["last"], d["label"]) for d in got[i].detections] == brute_detections(t, rules)
            assert set(got[i].base_labels) <= set(got[i].labels) and 0 <= got[i].score <= 1
    assert "apache-2.0" in got[1000].labels and "cc-by-4.0" in got[1002].labels and got[1003].labels == ["apache-2.0"] and got[1004].labels == ["mit"]


def test_suppression_by_level(spark):
    rules = [Signature("inner", "b licence", " b licence ", 0, 0.5), Signature("outer", "a b licence c", " a b licence ", 1, 0.5), Signature("late", "a b licence", " a b licence ", 2, 0.5)]
    one = spark.createDataFrame([(1, "A b licence c")], "doc_id bigint, text string")
    assert scan_licenses(one, rules=rules).first().labels == ["inner", "outer"]


def test_rules_are_gated_and_distinct():
    rules = signatures()
    assert 200 < len(rules) == len(set(rules))
    assert all(r.regex.startswith(ANCHORS[0]) or any(a in r.keyword for a in ANCHORS) for r in rules)


def test_odd_tables(spark, clashing, empty):
    assert scan_licenses(empty).count() == 0
    wide = scan_licenses(clashing, tuple(clashing.columns))
    assert wide.columns.count("n_words") == 1 and wide.count() == clashing.count()
