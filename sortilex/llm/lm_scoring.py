"""Language-model scoring by a weighted backoff automaton of all n-grams that occur at least twice.

States are the empty history, words, and pairs of words; state (u, v) is kept if the pair occurs ``LEAST`` times in the
training texts. A kept n-gram is an arc out of its history's state. Weights are smoothed by interpolated absolute
discounting: with c the counts, the arc of w out of state h has probability (c(hw) - D) / c(h) + fail(h) * p(w | h'), where
h' is h without its first word, and every other word takes the failure arc to h' at weight
fail(h) = 1 - sum over h's arcs of (c(hw) - D) / c(h). Words alone, out of the empty history, are add-``alpha``, so each
state's probabilities sum to 1. A text runs through the automaton once, from left to right, from the empty history.

The automaton grows with the corpus and is never gathered or broadcast: it is dealt out by n-gram, counted in its buckets,
and each block of texts gets back the part that its own texts can walk through. Everything sent is a whole number, so
results are the same in any order:

1. a block sends its different pairs and triples with their counts, a packet a bucket, and gets back the counts of kept
   ones and each pair's failure mass; buckets hand on each word's failure mass;
2. a block sends its different words with their counts, and gets back their counts and failure masses.

A word is known by a 64-bit code, as a history by 48 bits of it, and after a known history by its place among the frequent
words (``BRIEF`` of all tokens; there can't be many) or else by 31 bits. A word's pairs lie in a sixteenth of all
buckets, by their second words, and the triples of a frequent pair (``HOT`` of all tokens; there can't be many) likewise by
their third, so no word or pair is too much for a bucket. Blocks and buckets grow with the square root of the input beyond
``EVEN_BYTES``, so that packets don't shrink as their number grows.

Edge cases. Null or empty text: the end token alone. Null id: counts as empty text for the split. Repeated rows each
count and are scored. No training texts: every token is unknown and all of them have the same weight. Empty table: empty
result. A kept column named like a result column is replaced by the result; names that begin with __lm_ are the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import estimated_bytes
from .common import map_batches, materialize, release_shuffles, tokens, worker_cache

ALPHA, DISCOUNT = 0.1, 0.5
#: Occurrences from which on an n-gram is kept.
LEAST = 2
#: Bytes of text that a block takes (or one text), and tokens of all texts for each bucket.
BLOCK_BYTES, BUCKET_TOKENS, LEAST_BUCKETS = 4_000_000, 1_000_000, 64
EVEN_BYTES = 64 << 30
#: Share of all tokens from which on a pair's triples are dealt out over several buckets.
HOT = 1e-3
#: A word's pairs, or a hot pair's triples, lie in each APARTth bucket.
APART = 16
#: Share of all tokens, in the blocks where a word has it, from which on the word has a short code.
BRIEF = 1e-5
CACHE_WORDS = 300_000

RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

HISTORY = np.uint64(16)  # bits that a history's code lacks
_END = np.uint64(0x5851F42D4C957F2D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PARTS = "block bigint, bucket int, parts array<binary>, counted bigint"


def _word_codes(own: list[bytes], known: dict[bytes, int]) -> list[int]:
    if len(known) > CACHE_WORDS:
        known.clear()
    out = list(map(known.get, own, repeat(0)))
    if 0 in out:
        for i, c in enumerate(out):
            if not c:
                out[i] = known[own[i]] = xxhash.xxh64_intdigest(own[i]) or 1
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes each as the largest needs, compressed byte place by byte place."""
    if not len(a):
        return b""
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(a).to_bytes(7, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    n, width = int.from_bytes(blob[:7], "little"), blob[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob[8:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _pack_codes(codes: np.ndarray) -> bytes:
    """64-bit codes in ascending order."""
    return _pack(np.diff(codes, prepend=np.uint64(0)))


def _unpack_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob).view(np.uint64), dtype=np.uint64)


def _brief(codes: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits: the place in ``short`` (in ascending order), or 31 bits of the code and a one before them."""
    at = np.minimum(np.searchsorted(short, codes), max(0, len(short) - 1))
    found = short[at] == codes if len(short) else np.zeros(len(codes), bool)
    return np.where(found, at, ((codes >> np.uint64(33)) | np.uint64(1 << 31)).astype(np.int64))


def _sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    return np.bincount(at, values, n).astype(np.int64)


def encode(docs: DataFrame, kept: list[T.StructField], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of texts: block, rows (the kept columns), n and train tokens, sizes, held, words (different codes), and ids (places in words)."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType(kept))), T.StructField("n", T.LongType()), T.StructField("train", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "held", "words", "ids"))])

    def finish(block: int, parts: list[pa.RecordBatch], codes: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        sizes = np.array([len(c) for c in codes], np.int64)
        words, ids, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small numbers for frequent words
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held = table.column(table.num_columns - 1).to_numpy().astype(bool)
        rows = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], fields=[pa.field(f.name, c.type) for f, c in zip(kept, table.columns, strict=True)])
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        values = [pa.array([block], pa.int64()), listed, pa.array([int(sizes.sum())], pa.int64()), pa.array([int(sizes[~held].sum())], pa.int64())]
        values += [pa.array([x], pa.binary()) for x in (_pack(sizes), _pack(held.astype(np.int64)), words[order].tobytes(), _pack(place[ids]))]
        return pa.RecordBatch.from_arrays(values, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, known = TaskContext.get().partitionId() << 40, worker_cache(("word codes",), dict)
        parts, codes, taken = [], [], 0
        for batch in batches:
            lo = 0
            for i, s in enumerate(batch.column(batch.num_columns - 1)):
                own = tokens(s.as_buffer().to_pybytes()) if s.is_valid else []
                codes.append(np.append(np.array(_word_codes(own, known), np.uint64), _END))
                taken += len(s.as_buffer()) if s.is_valid else 0
                if taken >= block_bytes:
                    yield finish(block, [*parts, batch.slice(lo, i + 1 - lo).select(list(range(len(kept))))], codes)
                    block, lo, parts, codes, taken = block + 1, i + 1, [], [], 0
            if lo < batch.num_rows:
                parts.append(batch.slice(lo).select(list(range(len(kept)))))
        if codes:
            yield finish(block, parts, codes)

    return map_batches(docs, run, schema)


class Texts:
    """A block's texts as word numbers, with their different pairs and triples in the order of the packets."""

    def __init__(self, row: dict) -> None:
        self.sizes, self.ids = _unpack(row["sizes"]), _unpack(row["ids"])
        self.words = np.frombuffer(row["words"], np.uint64)
        self.train = np.repeat(_unpack(row["held"]) == 0, self.sizes)

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes u and v and numbers of pairs that have a share of ``HOT``, and of words (v is 0) that have one of ``BRIEF``."""
        n, counts = len(self.ids), np.bincount(self.ids, minlength=len(self.words))  # words come in order of frequency
        m, words = int((counts >= HOT * n).sum()), np.flatnonzero(counts >= max(2, BRIEF * n))
        a, b = self.ids[:-1], self.ids[1:]
        both = (a < m) & (b < m) & (self.words[a] != _END)
        pairs = np.bincount(a[both] * m + b[both], minlength=m * m)
        at = np.flatnonzero(pairs >= max(1, HOT * n))
        u, v = np.divmod(at, max(1, m))
        return np.concatenate((self.words[u], self.words[words])), np.concatenate((self.words[v], np.zeros(len(words), np.uint64))), np.concatenate((pairs[at], counts[words]))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.train], minlength=len(self.words))

    def find(self, bits: int, hot: np.ndarray, short: np.ndarray) -> Texts:
        """Finds pairs and triples; ``hot`` has the codes of frequent pairs, whose triples are dealt out over several buckets."""
        self.brief = _brief(self.words, short)
        n, spread = len(self.words), max(1, (1 << bits) // APART)
        inner = np.ones(len(self.ids), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        self.first = np.flatnonzero(inner)  # where pairs begin
        pairs, self.pair_at = np.unique(self.ids[self.first] * n + self.ids[self.first + 1], return_inverse=True)
        self.u, self.v = np.divmod(pairs, max(1, n))
        self.next = np.flatnonzero(np.diff(self.first) == 1)  # pairs (u, v) that the pair (v, w) follows
        triples, self.triple_at = np.unique(self.pair_at[self.next] * n + self.ids[self.first[self.next] + 2], return_inverse=True)
        self.history, self.w = np.divmod(triples, max(1, n))
        # Entries of packets: a pair, or one of a hot pair's shares; the first has the count.
        code, salt = self.words, (self.words % np.uint64(spread)).astype(np.int64)
        home = (_mix(code, code) >> np.uint64(64 - bits)).astype(np.int64)[self.u] + APART * salt[self.v]
        is_hot = np.isin(_mix(code[self.u], code[self.v]), _mix(hot[0], hot[1]))
        self.owner = np.repeat(np.arange(len(pairs)), np.where(is_hot, spread, 1))
        first = np.searchsorted(self.owner, np.arange(len(pairs)))
        share = np.arange(len(self.owner)) - first[self.owner]
        bucket = (home[self.owner] + APART * share) % (1 << bits)
        rank = np.empty(n, np.int64)
        rank[np.argsort(code)] = np.arange(n)
        self.order = np.argsort(bucket * n + rank[self.u[self.owner]], kind="stable")
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        entry = place[first[self.history] + np.where(is_hot[self.history], salt[self.w], 0)]
        self.order3 = np.argsort(entry, kind="stable")
        self.bucket, self.after, self.counts_here = bucket[self.order], np.bincount(entry, minlength=len(self.owner)), share[self.order] == 0
        return self

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_at[self.train[self.first]], minlength=len(self.u))

    def triple_counts(self) -> np.ndarray:
        return np.bincount(self.triple_at[self.train[self.first[self.next]]], minlength=len(self.w))

    def packets(self, bits: int) -> Iterator[tuple[int, list[bytes]]]:
        """Bucket and parts: first words, their numbers of pairs, second words, counts, numbers of triples, third words, counts."""
        pair = self.owner[self.order]
        first, second, third = self.words[self.u[pair]] >> HISTORY, self.brief[self.v[pair]], self.brief[self.w[self.order3]]
        n2, n3 = self.pair_counts()[pair] * self.counts_here, self.triple_counts()[self.order3]
        ends = np.searchsorted(self.bucket, np.arange(1 << bits), "right")
        ends3 = np.concatenate(([0], np.cumsum(self.after)))
        for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if hi > lo:
                head = np.flatnonzero(np.concatenate(([True], first[lo + 1 : hi] != first[lo : hi - 1])))
                lo3, hi3 = ends3[lo], ends3[hi]
                yield b, [_pack_codes(first[lo:hi][head]), _pack(np.diff(np.append(head, hi - lo))), _pack(second[lo:hi]), _pack(n2[lo:hi]), _pack(self.after[lo:hi]), _pack(third[lo3:hi3]), _pack(n3[lo3:hi3])]

    def answered(self, n2: np.ndarray, mass2: np.ndarray, n3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and failure masses by pair, and counts by triple, from the packets' answers."""
        pair = self.owner[self.order]
        c3 = np.empty(len(self.w), np.int64)
        c3[self.order3] = n3
        return _sum(pair, n2, len(self.u)), _sum(pair, mass2, len(self.u)), c3


def count_bucket(packets: list[list[bytes]], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each packet's answer (counts of kept pairs, their failure masses, counts of kept triples), and words' failure masses.

    A mass is the sum of 2 * count - 1 over the arcs kept.
    """
    heads = [(_unpack_codes(p[0]), _unpack(p[1])) for p in packets]
    second, after, third = ([_unpack(p[k]) for p in packets] for k in (2, 4, 5))
    sizes, sizes3 = [len(s) for s in second], [len(t) for t in third]
    words, at = np.unique(np.concatenate([np.repeat(c, n) for c, n in heads]), return_inverse=True)
    pairs, at = np.unique(at << 32 | np.concatenate(second), return_inverse=True)
    n2 = _sum(at, np.concatenate([_unpack(p[3]) for p in packets]), len(pairs))
    n2[n2 < least] = 0
    history = np.repeat(at, np.concatenate(after))
    triples, at3 = np.unique(history << 32 | np.concatenate(third), return_inverse=True)
    n3 = _sum(at3, np.concatenate([_unpack(p[6]) for p in packets]), len(triples))
    n3[n3 < least] = 0
    mass2 = _sum(triples >> 32, np.maximum(2 * n3 - 1, 0), len(pairs))
    mass1 = _sum(pairs >> 32, np.maximum(2 * n2 - 1, 0), len(words))
    cuts, cuts3 = np.cumsum(sizes)[:-1], np.cumsum(sizes3)[:-1]
    answers = zip(np.split(n2[at], cuts), np.split(mass2[at], cuts), np.split(n3[at3], cuts3), strict=True)
    return [[_pack(x) for x in a] for a in answers], words[mass1 > 0], mass1[mass1 > 0]


class Automaton:
    """The part of the automaton that a block's texts can walk through.

    ``fail1`` and ``fail2`` are the failure arcs' weights by word and pair, ``arc1`` to ``arc3`` the arcs' probabilities by
    word, pair and triple; 0 where there is no arc.
    """

    def __init__(self, texts: Texts, c1: np.ndarray, mass1: np.ndarray, c2: np.ndarray, mass2: np.ndarray, c3: np.ndarray, total: int, different: int, alpha: float) -> None:
        self.texts, self.known, self.state2 = texts, c1 > 0, c2 > 0
        self.fail1 = 1 - mass1 / np.maximum(2 * c1, 1)
        self.fail2 = np.where(self.state2, 1 - mass2 / np.maximum(2 * c2, 1), 1.0)
        self.arc1 = (c1 + alpha) / (total + alpha * (different + 1))
        arc2 = np.maximum(c2 - DISCOUNT, 0) / np.maximum(c1[texts.u], 1)
        self.arc2 = np.where(self.state2, arc2 + self.fail1[texts.u] * self.arc1[texts.v], 0)
        arc3 = np.maximum(c3 - DISCOUNT, 0) / np.maximum(c2[texts.history], 1)
        self.arc3 = np.where(c3 > 0, arc3, 0)

    def walk(self) -> np.ndarray:
        """Each token's probability, on one way through all texts.

        The state before a token is the longest kept history, so it follows from the two words before, and all tokens
        take their arcs, and the failure arcs before them, together.
        """
        t = self.texts
        p = self.arc1[t.ids]  # out of the empty history
        failed = self.fail1[t.ids[t.first]] * p[t.first + 1]
        arc = self.arc2[t.pair_at]
        p[t.first + 1] = np.where(arc > 0, arc, failed)  # out of a word
        at = t.first[t.next] + 2
        p[at] = self.arc3[t.triple_at] + self.fail2[t.pair_at[t.next]] * p[at]  # out of a pair; no state fails at weight 1
        return p

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, log10 probability by words alone, and by the automaton, of each text."""
        t = self.texts
        starts = np.cumsum(t.sizes) - t.sizes
        per_text = lambda x: np.add.reduceat(x, starts)
        return per_text(self.known[t.ids].astype(np.int64)), per_text(np.log10(self.arc1)[t.ids]), per_text(np.log10(self.walk()))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows without the kept columns, one at a time."""
    names = [c for c in batch.schema.names if c != "rows"]
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in names}


def _sent(rows: list[tuple[int, int, list[bytes], int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "bucket", "parts", "counted"])


def _by_first_bits(codes: np.ndarray, values: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, list[bytes]]]:
    """Codes of some width in ascending order and their values, a packet for each bucket."""
    ends = np.searchsorted(codes >> np.uint64(width - bits), np.arange(1 << bits, dtype=np.uint64), "right").tolist()
    for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if hi > lo:
            yield b, [_pack_codes(codes[lo:hi]), _pack(values[lo:hi])]


def _buckets(sent: DataFrame, answer: Callable[[int, list[dict]], Iterator[tuple]], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = (r for batch in batches for r in _rows(batch))
        for bucket, own in groupby(packets, lambda r: r["bucket"]):
            yield _sent(list(answer(bucket, list(own))))

    return materialize(map_batches(sent.repartition("bucket").sortWithinPartitions("bucket", "block"), run, _PARTS), name)


def _answers(found: DataFrame, name: str) -> DataFrame:
    parts = found.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "parts"))).alias("p"))
    return parts.select("block", F.col("p.parts").alias(name))


def _joined(packets: list[list[bytes]] | None, k: int) -> np.ndarray:
    return np.concatenate([_unpack(p[k]) for p in packets]) if packets else np.empty(0, np.int64)


def lm_scores(docs: DataFrame, held_out: Column, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", least: int = LEAST, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score; learns from rows not held out."""
    keep = tuple(c for c in keep if c not in {*RESULT, "held_out"})
    rows = docs.select(*keep, held_out.alias("held_out"), F.col(text_col).alias("__lm_text"))
    kept = rows.schema.fields[:-1]
    growth = max(1.0, math.sqrt(estimated_bytes(docs) / EVEN_BYTES))
    blocks = materialize(encode(rows, kept, int(growth * block_bytes)), "lm-blocks")
    n, total = (int(x or 0) for x in blocks.agg(F.sum("n"), F.sum("train")).first())
    bits = (max(LEAST_BUCKETS, math.ceil(n / (growth * BUCKET_TOKENS))) - 1).bit_length()
    texts = blocks.select("block", "sizes", "held", "words", "ids")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _rows(batch)):
            u, v, k = Texts(r).frequent()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(k, pa.int64())], names=["u", "v", "n"])

    least_share = F.when(F.col("v") == 0, BRIEF).otherwise(HOT)
    found = map_batches(texts, frequent, "u bigint, v bigint, n bigint").groupBy("u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= least_share * n)
    often = np.array([[r.u, r.v] for r in found.collect()], np.int64).reshape(-1, 2).T.view(np.uint64)  # 1 / BRIEF + 1 / HOT rows at most
    short, hot = np.sort(often[0][often[1] == 0]), often[:, often[1] != 0]

    def send_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _rows(batch)):
            yield _sent([(r["block"], b, parts, 0) for b, parts in Texts(r).find(bits, hot, short).packets(bits)])

    def count_ngrams(bucket: int, own: list[dict]) -> Iterator[tuple]:
        answers, words, mass = count_bucket([r["parts"] for r in own], least)
        yield from ((r["block"], bucket, a, 0) for r, a in zip(own, answers, strict=True))
        yield from ((-1, b, parts, 0) for b, parts in _by_first_bits(words, mass, bits, 64 - int(HISTORY)))

    ngrams = _buckets(map_batches(texts, send_ngrams, _PARTS), count_ngrams, "lm-ngrams")
    release_shuffles(docs.sparkSession)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _rows(batch)):
            t = Texts(r)
            order = np.argsort(t.words)
            yield _sent([(r["block"], b, parts, 0) for b, parts in _by_first_bits(t.words[order], t.word_counts()[order], bits)])

    def count_words(bucket: int, own: list[dict]) -> Iterator[tuple]:
        asking, shares = [r for r in own if r["block"] >= 0], [r for r in own if r["block"] < 0]
        if not asking:
            return
        codes = [_unpack_codes(r["parts"][0]) for r in asking]
        different, at = np.unique(np.concatenate(codes), return_inverse=True)
        c1 = _sum(at, np.concatenate([_unpack(r["parts"][1]) for r in asking]), len(different))
        mass = np.zeros(len(different), np.int64)
        for r in shares:
            np.add.at(mass, np.searchsorted(different >> HISTORY, _unpack_codes(r["parts"][0])), _unpack(r["parts"][1]))
        yield -1, bucket, [], int((c1 > 0).sum())
        for r, k in zip(asking, np.split(at, np.cumsum([len(c) for c in codes])[:-1]), strict=True):
            yield r["block"], bucket, [_pack(c1[k]), _pack(mass[k])], 0

    shares = ngrams.where("block < 0")
    words = _buckets(map_batches(texts, send_words, _PARTS).unionByName(shares), count_words, "lm-words")
    release_shuffles(docs.sparkSession)
    different = int(words.agg(F.sum("counted")).first()[0] or 0)
    schema = T.StructType([*kept, *(T.StructField(f"__lm_{c}", T.LongType() if c.startswith("n_") else T.DoubleType()) for c in ("n_tokens", "n_known", "base_score", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(_rows(batch)):
                t = Texts(r).find(bits, hot, short)
                c1, mass1 = np.empty(len(t.words), np.int64), np.empty(len(t.words), np.int64)
                order = np.argsort(t.words)
                c1[order], mass1[order] = _joined(r["words_found"], 0), _joined(r["words_found"], 1)
                known, base, score = Automaton(t, c1, mass1, *t.answered(*(_joined(r["found"], k) for k in range(3))), total, different, alpha).scores()
                own = batch.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([*own.flatten(), pa.array(t.sizes), pa.array(known), pa.array(base), pa.array(score)], names=schema.names)

    walked = blocks.drop("n", "train").join(_answers(words, "words_found"), "block").join(_answers(ngrams, "found"), "block", "left")
    scored = map_batches(walked, run, schema)
    return scored.select(*keep, "held_out", F.col("__lm_n_tokens").alias("n_tokens"), F.col("__lm_n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("__lm_base_score").alias("base_score"), F.col("__lm_score").alias("score"))
