"""Shared pieces of the text operators: words, hashed shingles, Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of letters and digits (of any script), compared in lower case.
WORD = re.compile(r"[^\W_]+")
#: Java spelling of "holds at least three words"; used to drop texts before they reach Python.
THREE_WORDS = r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]"
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (two multiply-xorshift rounds)."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX_2
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it belongs to words, and its mixed value."""
    points = np.arange(0x110000, dtype=np.uint64)
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000), mix64(points + np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=8)
def _powers(count: int) -> np.ndarray:
    factors = np.full(count, 0xD6E8FEB86659FD93, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of each word in its order, texts by their position: a polynomial of the word's
    mixed characters, all words of a batch at once."""
    texts = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    belongs, mixed = _characters()
    at = np.flatnonzero(belongs[points])
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(at)])
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    powers = _powers(1 << int(sizes.max()).bit_length())
    codes = mix64(np.add.reduceat(mixed[points[at]] * powers[place], starts))
    return np.searchsorted(np.cumsum(lengths), at[starts], side="right"), codes


def _by_text_and_hash(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of ``lexsort((code, doc))``, by one key of the text and the hash's upper bits."""
    if len(doc) and doc[-1] < 1 << 16:
        key = doc.astype(np.uint64) << np.uint64(48) | code >> np.uint64(16)
        order = np.argsort(key)
        key, code = key[order], code[order]
        if not ((key[1:] == key[:-1]) & (code[1:] < code[:-1])).any():
            return order
    return np.lexsort((code, doc))


def shingles(texts: Iterable[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of ``size`` words of each text.

    Returns ``(doc, hash)`` sorted by document and hash: the documents are positions in ``texts``.
    A text that is None or has fewer than ``size`` words has no entry.
    """
    doc, flat = word_hashes(texts)
    if len(flat) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    count = len(flat) - size + 1
    code = flat[:count].copy()
    for step in range(1, size):
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + flat[step : step + count])
    whole = doc[:count] == doc[size - 1 :]
    doc, code = doc[:count][whole], code[whole]
    order = _by_text_and_hash(doc, code)
    doc, code = doc[order], code[order]
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        doc, code = doc[new], code[new]
    return doc, code


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes; 0.0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> tuple[DataFrame, int]:
    """``(at most bound rows, number of rows)``: the rows whose key has the smallest hashes.

    Rows far from the smallest hashes are left out first, so that no task sends more than its share.
    """
    count = rows.count()
    share = min(1.0, 2.0 * bound / max(count, 1))
    draw = F.xxhash64(key, F.lit("sample"))
    if share < 1.0:
        rows = rows.where(F.shiftrightunsigned(draw, 1) < F.lit(int(share * (2**63 - 1))))
    return rows.orderBy(draw, key).limit(bound), count
