"""Helpers shared by the training-data operators: word splitting and columns; storage comes from the library."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.storage import map_batches, materialize, new_path, release_shuffles, remove, shared_dir, small_batches, temporary

__all__ = ["crc_of_id", "map_batches", "materialize", "new_path", "release_shuffles", "remove", "shared_dir", "small_batches", "temporary", "tokens", "uniform", "words", "worker_cache"]

#: Byte table: A-Z to lower case, everything that cannot be part of a word to a space.
#: Bytes of 0x80 and above only occur inside non-ASCII characters, which all count as word characters.
WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: The same word class, and white-space separated tokens, for Java's regular expressions.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: bytes) -> list[bytes]:
    """Alphanumeric words of UTF-8 bytes, ASCII letters lower-cased."""
    return text.translate(WORD_TABLE).split()


#: bytes.split() without an argument cuts at exactly 0x20 and 0x09-0x0D.
def tokens(text: bytes) -> list[bytes]:
    """White-space separated tokens of UTF-8 bytes, ASCII letters lower-cased."""
    return text.lower().split()


Cache = TypeVar("Cache")
_cache: dict[tuple, object] = {}


def worker_cache(key: tuple, make: Callable[[], Cache]) -> Cache:
    """What this Python process remembers under a key. Workers outlive tasks, so whatever another operator left goes."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def uniform(seed: str, *cols: Column | str) -> Column:
    """A number strictly between 0 and 1 that depends only on the values and the seed."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
