"""Language identification with hyperdimensional profiles.

Every letter gets a random vector of +1 and -1 that depends only on its code point. A trigram's vector binds its
letters' vectors by multiplication, each rotated by its place; a text's vector bundles (adds) those of its trigrams, and
a language's prototype those of all its training texts. A text gets the language whose prototype has the largest cosine
with it. Trigrams lie within words, with a space at each end; all but letters counts as space.

Bundles are sums of integers, so training adds up each task's bundles: all labelled rows count, in any order, and each
task hands on one vector for each language it met.

Edge cases. Null text, or one without letters: ``und``, score 0. Rows with null language aren't learned from. Nothing
learned at all: ``und`` for every row. Ties go to the language that comes first by code point. Repeated rows count as
often as they occur. Empty table: empty result. A kept column named like a result column is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, worker_cache

DIM, SEED = 1024, 20_011
#: Texts and characters that are turned into vectors together, and trigram vectors that a worker remembers (1 kB each).
BATCH_TEXTS, BATCH_CHARS, CACHE_TRIGRAMS = 64, 400_000, 60_000
#: Languages whose prototypes (8 kB each) are broadcast together; with more, texts pass once for each such block.
BLOCK_LANGUAGES = 4096
NO_LANGUAGE = "und"

_SPACE, _BITS = 32, 21


class Profiles:
    """Turns batches of texts into trigram counts and vectors."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, self.dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, self.dim, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def trigram(self, code: int) -> np.ndarray:
        a, b, c = (code >> (_BITS * k) & (1 << _BITS) - 1 for k in (2, 1, 0))
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of different trigrams, as floats (whole numbers, so sums below 2**24 are exact)."""
        if len(self.rows) + len(codes) > CACHE_TRIGRAMS:
            self._forget()
        at = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            row = self.rows.get(code)
            if row is None:
                row = self.rows[code] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
                self.vectors[row] = self.trigram(code)
            at[i] = row
        return self.vectors[at].astype(np.float32)

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and code of every trigram."""
        padded = [f" {t.lower()} " for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
        owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
        letter = self.is_letter[chars]
        chars = np.where(letter, chars, _SPACE).astype(np.int64)
        kept = letter | np.concatenate(([True], letter[:-1]))
        chars, owner = chars[kept], owner[kept]
        if len(chars) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inner = chars[1:-1] != _SPACE
        codes = (chars[:-2] << 2 * _BITS) | (chars[1:-1] << _BITS) | chars[2:]
        return owner[1:-1][inner], codes[inner]

    def bundle(self, groups: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """One vector for each of n groups of trigrams."""
        different, at = np.unique(codes, return_inverse=True)
        out = np.zeros((n, self.dim), np.float32)
        for i in range(0, len(different), 16_384):
            part = different[i : i + 16_384]
            own = (at >= i) & (at < i + len(part))
            counts = np.bincount(groups[own] * len(part) + (at[own] - i), minlength=n * len(part)).reshape(n, -1)
            out += counts.astype(np.float32) @ self.lookup(part)
        return out


Prototypes = dict[str, np.ndarray] | DataFrame


def profiles(dim: int) -> Profiles:
    """This process's vectors."""
    return worker_cache(("profiles", dim), lambda: Profiles(dim))


def _groups(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows (first row, texts) of bounded size."""
    texts, start, chars = [], 0, 0
    for i, s in enumerate(batch.column(at)):
        texts.append(s.as_py() or "")
        chars += len(texts[-1])
        if len(texts) >= BATCH_TEXTS or chars >= BATCH_CHARS:
            yield start, texts
            texts, start, chars = [], i + 1, 0
    if texts:
        yield start, texts


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> Prototypes:
    """Prototype of each language, from all rows with a language and a text; a table of them if they are many."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sums = profiles(dim), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in _groups(batch, 1):
                own = langs[start : start + len(texts)]
                names = sorted(set(own))
                owner, codes = p.trigrams(texts)
                number = np.array([names.index(x) for x in own], np.int64)
                for name, v in zip(names, p.bundle(number[owner], codes, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        yield _vectors(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(v, np.int64)
        yield _vectors(sums)

    rows = labelled.select(F.col(lang_col), F.col(text_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    partial = map_batches(rows, local, "lang string, v binary")
    found = materialize(map_batches(partial.repartition("lang"), total, "lang string, v binary"), "language-prototypes")
    if found.count() > BLOCK_LANGUAGES:
        return found
    return {r.lang: np.frombuffer(r.v, np.int64) for r in found.orderBy("lang").collect()}


def _in_blocks(prototypes: Prototypes, languages: int) -> Iterator[dict[str, np.ndarray]]:
    """Blocks in order of the languages; a table streams to the driver one block at a time."""
    if isinstance(prototypes, dict):
        rows = iter(sorted(prototypes.items()))
    else:
        rows = ((r.lang, np.frombuffer(r.v, np.int64)) for r in prototypes.orderBy("lang").toLocalIterator())
    while block := dict(islice(rows, languages)):
        yield block


def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    sums = {lang: v for lang, v in sums.items() if np.any(v)}
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])


def predict(docs: DataFrame, prototypes: Prototypes, keep: tuple[str | Column, ...] = ("doc_id",), text_col: str = "text", dim: int = DIM, block_languages: int = BLOCK_LANGUAGES) -> DataFrame:
    """``keep``, lang_pred and score (the cosine, 0 if negative)."""
    head = docs.select(*keep)
    kept = [f for f in head.schema.fields if f.name not in {"lang_pred", "score"}]
    has_text = text_col in [c for c in keep if isinstance(c, str)]
    rows = docs.select(*(c for c, f in zip(keep, head.schema.fields, strict=True) if f in kept), *([] if has_text else [F.col(text_col).alias("__text")]))
    at, passed = rows.columns.index(text_col if has_text else "__text"), rows.schema.fields
    result = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    blocks = _in_blocks(prototypes, block_languages)
    block, first = next(blocks, {}), True
    while block is not None:
        following = next(blocks, None)
        fields = [*(kept if following is None else passed), *result]
        rows = _label(rows, block, at, len(fields) - 2, first, following is None, T.StructType(fields), dim)
        if following is not None:
            rows = materialize(rows, "language-id")
        block, first = following, False
    return rows


def _label(rows: DataFrame, prototypes: dict[str, np.ndarray], at: int, n_kept: int, first: bool, last: bool, schema: T.StructType, dim: int) -> DataFrame:
    """The first columns, and the best language and cosine so far."""
    held = rows.sparkSession.sparkContext.broadcast(prototypes)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, names = profiles(dim), np.array(list(held.value), object)
        protos = np.array([v / np.linalg.norm(v.astype(np.float64)) for v in held.value.values()], np.float64)
        for batch in batches:
            langs, scores = [np.empty(0, object)], [np.empty(0)]
            for _, texts in _groups(batch, at):
                owner, codes = p.trigrams(texts)
                own, best = np.full(len(texts), NO_LANGUAGE, object), np.zeros(len(texts))
                if len(names) and len(codes):
                    v = p.bundle(owner, codes, len(texts)).astype(np.float64)
                    norms = np.linalg.norm(v, axis=1)
                    cosines = np.round(v @ protos.T / np.where(norms > 0, norms, 1)[:, None], 9)
                    some = np.bincount(owner, minlength=len(texts)) > 0
                    own[some] = names[cosines.argmax(axis=1)][some]
                    best[some] = cosines.max(axis=1)[some]
                langs.append(own)
                scores.append(best)
            lang, score = np.concatenate(langs), np.concatenate(scores)
            if not first:
                before = batch.column(batch.num_columns - 1).to_numpy()
                lang = np.where(score > before, lang, batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False))
                score = np.maximum(score, before)
            score = np.clip(score, 0, 1) if last else score
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return map_batches(rows, label, schema)
