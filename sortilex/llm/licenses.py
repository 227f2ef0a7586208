"""License scans: ordered signature rules over normalised words, all in DataFrame expressions.

A text that holds one of a few anchor words is normalised to lower-case words between single spaces. A rule is a regular
expression over whole words; it runs only if its keyword occurs. Rules come in levels (0 first): a detection whose words
lie within those of a detection of the same or an earlier level is suppressed. Base phrases are rules of level 0 that
report every place and are never suppressed.

Positions come from marks: a rule's matches are marked at their first and last word, and the marked words' indices are
the detection's interval, so the work is linear in the text for each rule whose keyword occurs.

Edge cases. Null or empty text: no words, no detections, score 0. Equal intervals: the earlier level wins, then the label
first by code point. Repeated rows each are judged. Empty table: empty result. Columns besides ``keep`` and the text are
not read; a kept column named like a result column is replaced by the result.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RAW_WORD_RE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
NO_WORD_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Every keyword holds one of these, or its rule begins with the first, so a text without any of them has no detection.
ANCHORS = ("licen", "spdx", "cc ", "creative commons", "permission", "redistribution", "public domain", "copyleft", "all rights")

#: Phrases whose every place is reported, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, name in words and versions of license families; rules for their usual mentions are made from these.
FAMILIES = (
    ("gpl", "gnu general public", ("1 0", "2 0", "3 0")),
    ("gpl", "gnu gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", "gnu lesser general public", ("2 1", "3 0")),
    ("lgpl", "gnu library general public", ("2 0",)),
    ("agpl", "gnu affero general public", ("1 0", "3 0")),
    ("gfdl", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("1 0", "1 1", "2 0")),
    ("mit", "mit", ()),
    ("mit", "expat", ()),
    ("bsd-2-clause", "bsd 2 clause", ()),
    ("bsd-2-clause", "simplified bsd", ()),
    ("bsd-3-clause", "bsd 3 clause", ()),
    ("bsd-3-clause", "new bsd", ()),
    ("bsd-4-clause", "bsd 4 clause", ()),
    ("bsd", "bsd", ()),
    ("isc", "isc", ()),
    ("mpl", "mozilla public", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public", ("1 0", "2 0")),
    ("cddl", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common public", ("1 0",)),
    ("eupl", "european union public", ("1 0", "1 1", "1 2")),
    ("osl", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "boost software", ("1 0",)),
    ("zlib", "zlib", ()),
    ("zlib", "zlib libpng", ()),
    ("wtfpl", "do what the fuck you want to public", ()),
    ("unlicense", "the unlicense", ()),
    ("ms-pl", "microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", ()),
    ("ofl", "sil open font", ("1 0", "1 1")),
    ("ncsa", "university of illinois ncsa open source", ()),
    ("python", "python software foundation", ("2 0",)),
    ("php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", ()),
    ("postgresql", "postgresql", ()),
    ("openssl", "openssl", ()),
    ("odbl", "open database", ("1 0",)),
    ("odc-by", "open data commons attribution", ("1 0",)),
)
#: Creative Commons elements in words and in labels, and versions.
CC_PARTS = (("attribution", "by"), ("attribution sharealike", "by-sa"), ("attribution noncommercial", "by-nc"), ("attribution noderivatives", "by-nd"), ("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noncommercial noderivatives", "by-nc-nd"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences that only one license has: label and words.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("cc0", "creative commons zero"),
    ("proprietary", "all rights reserved"),
    ("copyleft", "copyleft"),
)

RESULT = ("n_words", "base", "detections", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Signature:
    """A rule: ``regex`` matches words joined by single spaces and runs only where ``keyword`` occurs."""

    label: str
    regex: str
    keyword: str
    level: int
    weight: float
    base: bool = False


def signatures() -> list[Signature]:
    """All rules, in order: base phrases, tags, full mentions with version, mentions without."""
    out = [Signature(label, phrase, f" {phrase} ", 0, 0.9, True) for phrase, label in BASE.items()]
    of = r"(?:under |by )?(?:the )?(?:terms of )?(?:the )?"
    for label, name, versions in FAMILIES:
        for v in versions:
            dashed = f"{label}-{v.replace(' ', '.')}"
            out.append(Signature(dashed, rf"{name} licen[cs]e (?:version |v)?{v}", f" {name} licen", 1, 0.95))
            out.append(Signature(dashed, rf"spdx license identifier {label.replace('-', ' ')} {v}(?: only| or later)?", " spdx license identifier ", 0, 1.0))
        out.append(Signature(label, rf"licen[cs]ed {of}{name}(?: licen[cs]e)?", f" {name} ", 1, 0.9) if " " in name else Signature(label, rf"licen[cs]ed {of}{name} licen[cs]e", f" {name} licen", 1, 0.9))
        out.append(Signature(label, rf"(?:the )?{name} licen[cs]e", f" {name} licen", 2, 0.8))
        if not versions:
            out.append(Signature(label, rf"spdx license identifier {label.replace('-', ' ')}", " spdx license identifier ", 0, 1.0))
    for name, short in CC_PARTS:
        spaced = short.replace("-", " ")
        for v in CC_VERSIONS:
            dashed = f"cc-{short}-{v.replace(' ', '.')}"
            out.append(Signature(dashed, rf"creative commons {name} {v}(?: (?:international|unported|generic))?(?: licen[cs]e)?", " creative commons ", 1, 0.95))
            out.append(Signature(dashed, rf"(?:spdx license identifier )?cc {spaced} {v}", f" cc {spaced} ", 1, 0.9))
        out.append(Signature(f"cc-{short}", rf"creative commons {name}(?: licen[cs]e)?", " creative commons ", 2, 0.8))
        out.append(Signature(f"cc-{short}", rf"cc {spaced}(?: licen[cs]e)?", f" cc {spaced} ", 2, 0.6))
    out += [Signature(label, words, f" {words} ", 1, 0.5 if label in ("proprietary", "copyleft") else 0.9) for label, words in SENTENCES]
    return list(dict.fromkeys(out))


def _has_anchor(s: Signature) -> bool:
    return s.regex.startswith(ANCHORS[0]) or any(a in s.keyword for a in ANCHORS)


def _gate(text: Column) -> Column:
    gap = NO_WORD_RE
    parts = [a.strip().replace(" ", gap) + (NO_WORD_RE if a.endswith(" ") else "") for a in ANCHORS]
    return text.rlike("(?i)" + "|".join(parts))


def _spans(norm: Column, rule: Column) -> Column:
    """Intervals of a rule's matches, as words counted from 0."""
    pattern = F.concat(F.lit(" ("), rule["regex"], F.lit(")(?= )"))
    marked = F.split(F.trim(F.regexp_replace(norm, pattern, F.lit(" \x01$1\x02"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\x01"), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith("\x02"), i)), lambda i: i.isNotNull())
    level = rule["level"]
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("long").alias("first"), (-b).cast("long").alias("minus_last"), level.alias("level"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")))


def _unsuppressed(found: Column, levels: int) -> Column:
    """Detections whose interval no earlier or equal level contains; found is sorted by start, longest first."""
    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("reach"), F.slice(found, 1, 0).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        last = -d["minus_last"]
        hidden = F.exists(F.slice(acc["reach"], F.lit(1), d["level"] + 1), lambda e: e >= last)
        reach = F.transform(acc["reach"], lambda e, i: F.when(i == d["level"], F.greatest(e, last)).otherwise(e))
        return F.struct(reach.alias("reach"), F.when(hidden, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step)["kept"]


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """``keep``, n_words, base and detections (first, last word, label, weight), base_labels, labels and score."""
    rules = signatures() if rules is None else rules
    if not all(map(_has_anchor, rules)):
        raise ValueError("each rule needs one of ANCHORS")
    keep = tuple(c for c in keep if c not in RESULT)
    kind = "array<struct<label:string,regex:string,keyword:string,level:int,weight:double,base:boolean>>"
    table = F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), kind)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD_RE, " ")), F.lit(" "))
    df = docs.select(F.struct(*keep).alias("__row"), F.regexp_count(text, F.lit(RAW_WORD_RE)).cast("long").alias("n_words"), F.when(_gate(text), norm).alias("__norm"))
    due = F.filter(table, lambda r: F.contains(F.col("__norm"), r["keyword"]))
    df = df.withColumn("__due", F.when(F.col("__norm").isNotNull(), due))
    found = F.array_sort(F.flatten(F.transform(F.col("__due"), lambda r: _spans(F.col("__norm"), r))))
    df = df.withColumn("__found", F.when(F.size("__due") > 0, found))
    some = F.col("__found").isNotNull()
    df = df.withColumns({"__base": F.when(some, F.filter("__found", lambda d: d["base"])), "__kept": F.when(some, _unsuppressed(F.col("__found"), 1 + max(r.level for r in rules)))})

    def plain(found: Column) -> Column:
        out = F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["minus_last"]).alias("last"), d["label"].alias("label"), d["weight"].alias("weight")))
        return F.coalesce(out, F.array().cast("array<struct<first:bigint,last:bigint,label:string,weight:double>>"))

    def labels(*found: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(*[F.transform(f, lambda d: d["label"]) for f in found])))

    df = df.select("__row", "n_words", plain(F.col("__base")).alias("base"), plain(F.col("__kept")).alias("detections"))
    best = F.coalesce(F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["weight"])), F.lit(0.0))
    return df.select("__row.*", "n_words", "base", "detections", labels(F.col("base")).alias("base_labels"), labels(F.col("base"), F.col("detections")).alias("labels"), best.alias("score"))
