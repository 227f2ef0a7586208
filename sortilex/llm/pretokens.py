"""Byte-level BPE ids by white-space piece, with the library's own results kept in a worker's cache.

The vocabulary's pre-tokenizer never joins characters across a single space that stands between two other characters
that are not white space: such a space always starts a new pre-token. A text can therefore be cut there and each piece
(the space and what follows) encoded alone and remembered. Where a space touches other white space or an end of the
text, the pieces around it are joined again and encoded as one, so results are the library's for every text. New pieces are
encoded as one text: tokens that begin with a space, and no others, begin a piece. A piece of letters is one pre-token, and
marks that end such a piece another, so words go to the library already split and in the vocabulary's spelling.

All this holds for a byte-level pre-tokenizer with the usual split, without a normaliser and with special strings in <| |>.
With any other, whole texts are encoded.
"""

from __future__ import annotations

import codecs
import json
import os
import string
from array import array
from collections.abc import Iterator

import numpy as np

from .common import worker_cache

#: Entries of the newer half of a worker's cache (each about 150 bytes); when it is full, the older half is forgotten.
CACHE_ENTRIES = 600_000
#: First pieces of texts that a worker remembers; all are forgotten at once.
FIRST_ENTRIES = 30_000

#: Texts and characters that are looked up together.
GROUP_TEXTS, GROUP_CHARS = 64, 400_000

SPACE = "Ġ"  # a space in the vocabulary's spelling of bytes
#: That spelling by byte, for texts of words between spaces: letters as they are, 0x7F to 0xA0 and 0xAD as later characters.
SPELLING = "".join(chr(b if b == 32 or 33 <= b < 127 or b > 160 and b != 173 else 256 + 34 + b - 128 if 127 < b < 161 else 323 if b == 173 else 289 if b == 127 else 256 + b) for b in range(256))

class PieceEncoder:
    """ids(text) for one tokenizer file; pieces seen before come from the cache."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("u4" if self.wide else "u2")
        self.code = self.dtype.char
        self.cache_entries = cache_entries
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        special = all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in made["added_tokens"])
        plain = made["model"].get("type") == "BPE" and not made["normalizer"] and special
        self.by_piece = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t[0] == SPACE]] = True
        self.by_word = Tokenizer(self.tokenizer.model)
        self.by_word.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.marks: dict[str, bytes] = {}
        self.cache: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes] = {}
        self.older: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that may be cut off, each with a space before it."""
        return self._cut(self.tokenizer, " " + " ".join(pieces), len(pieces)) or self.encode([" " + p for p in pieces])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """As encode_pieces, of letters alone."""
        text = " ".join(words)
        if not text.isascii():
            try:
                text.encode("latin-1")  # Python and the library may differ about later letters
            except UnicodeEncodeError:
                return self.encode_pieces(words)
            text = codecs.charmap_decode(text.encode(), "strict", SPELLING)[0]
        return self._cut(self.by_word, SPACE + text.replace(" ", " " + SPACE), len(words)) or self.encode_pieces(words)

    def _cut(self, tokenizer, text: str, n: int) -> list[bytes] | None:
        """A text's ids before each token that begins with a space, if these are n."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        starts = (np.flatnonzero(self.opens[ids]) * self.dtype.itemsize).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)] if len(starts) == n else None

    def mark(self, marks: str) -> bytes:
        """Of marks after letters."""
        if marks not in self.marks:
            if len(self.marks) >= FIRST_ENTRIES:
                self.marks.clear()
            self.marks[marks] = self.encode([marks])[0]
        return self.marks[marks]

    def learn(self, pieces: list[str]) -> None:
        """Remember pieces (without the space before them); None marks those that can't be cut off."""
        cache, older = self.cache, self.older
        words: dict[str, None] = {}
        others: dict[str, None] = {}
        ended: list[tuple[str, str]] = []
        for p in dict.fromkeys(pieces):
            if p in older:
                cache[p] = older[p]
            elif p.isalpha():
                words[p] = None
            elif not p or p[0].isspace() or p[-1].isspace():
                cache[p] = None
            elif (stem := p.rstrip(string.punctuation)).isalpha():
                ended.append((p, stem))
                if stem in older:
                    cache[stem] = older[stem]
                elif stem not in cache:
                    words[stem] = None
            else:
                others[p] = None
        if words:
            cache.update(zip(words, self.encode_words(list(words)), strict=True))
        if others:
            cache.update(zip(others, self.encode_pieces(list(others)), strict=True))
        for p, stem in ended:
            cache[p] = cache[stem] + self.mark(p[len(stem) :])

    def _look_up(self, lists: list[list[str]]) -> list[list[bytes | None]]:
        """Each list's pieces from the cache, learning those that it misses."""
        found = [list(map(self.cache.get, pieces)) for pieces in lists]
        holes = [[i for i, x in enumerate(own) if x is None] for own in found]
        missing = [p for pieces, at in zip(lists, holes, strict=True) for i in at if (p := pieces[i]) not in self.cache]
        if len(self.cache) + len(missing) > self.cache_entries:
            self.older, self.cache = self.cache, {}
        self.learn(missing)
        for pieces, own, at in zip(lists, found, holes, strict=True):
            for i in at:
                own[i] = self.cache.get(pieces[i])
        return found

    def _first_ids(self, firsts: list[str]) -> list[bytes]:
        """Of texts' first pieces, which have no space before them."""
        if len(self.firsts) > FIRST_ENTRIES:
            self.firsts.clear()
        new = list({p for p in firsts if p not in self.firsts})
        self.firsts.update(zip(new, self.encode(new) if new else [], strict=True))
        return [self.firsts[p] for p in firsts]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, as integers of ``dtype``."""
        if not self.by_piece:
            return self.encode(texts)
        lists = [t.split(" ") for t in texts]
        firsts = [pieces.pop(0) for pieces in lists]
        out = []
        for first, ids, pieces, own in zip(firsts, self._first_ids(firsts), lists, self._look_up(lists), strict=True):
            broken = None in own or pieces and (not first or first[-1].isspace())
            out.append(self._joined([first, *pieces]) if broken else ids + b"".join(own))
        return out

    def counts_of(self, texts: list[str], known: dict[str, int]) -> list[int]:
        """Number of ids of each text; known has the numbers of pieces that are looked up first."""
        size = self.dtype.itemsize
        if not self.by_piece:
            return [len(x) // size for x in self.encode(texts)]
        lists = [t.split(" ") for t in texts]
        firsts = [pieces.pop(0) for pieces in lists]
        sizes = [list(map(known.get, pieces)) for pieces in lists]
        rest = [[p for p, n in zip(pieces, own, strict=True) if n is None] for pieces, own in zip(lists, sizes, strict=True)]
        out = []
        for first, ids, pieces, counted, own in zip(firsts, self._first_ids(firsts), lists, sizes, self._look_up(rest), strict=True):
            if None in own or pieces and (not first or first[-1].isspace()):
                out.append(len(self._joined([first, *pieces])) // size)
            else:
                out.append(sum(filter(None, counted)) + (len(b"".join(own)) + len(ids)) // size)
        return out

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def count(self, text: str, known: dict[str, int]) -> int:
        return self.counts_of([text], known)[0]

    def _joined(self, pieces: list[str]) -> bytes:
        """As ids(), for texts with spaces where no cut may be made: those pieces are joined to their neighbours."""
        parts: list[str] = [pieces[0]]
        cut = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in pieces]
        cut[0] = bool(pieces[0]) and not pieces[0][-1].isspace()
        whole = [True]
        for i in range(1, len(pieces)):
            if cut[i] and cut[i - 1]:
                parts.append(pieces[i])
                whole.append(True)
            else:
                parts[-1] += " " + pieces[i]
                whole[-1] = False
        out: list[bytes | None] = [self.cache.get(p) if w and i else None for i, (p, w) in enumerate(zip(parts, whole, strict=True))]
        todo = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(todo, self.encode([" " + parts[i] if i else parts[i] for i in todo]), strict=True):
            out[i] = x
        return b"".join(out)


def text_groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded size."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i - lo + 1 >= GROUP_TEXTS or size >= GROUP_CHARS:
            yield texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a tokenizer file."""
    return worker_cache(("encoder", path), lambda: PieceEncoder(path))
