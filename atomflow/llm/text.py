"""Words and 64-bit hashes of words, vectorised over batches of whole texts.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]`` in the UTF-8 form of a
text. Words and runs of words are hashed with polynomials modulo 2**64 whose bases are fixed
odd numbers, followed by a bijective mix. Two different runs get the same hash with a chance
of about 2**-64; n compared runs therefore meet by accident about n*n/2**65 times.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; memory is about 40 times this.
BLOCK = 1 << 19
#: Bytes of texts of a part of a batch, about.
PART = 1 << 20

_BASE_BYTES = 0x9E3779B97F4A7C15
_BASE_WORDS = 0xD1342543DE82EF95
#: Base of a second, independent hash of runs.
OTHER = 0xA24BAED4963EE407
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: What Python workers keep between tasks for one operator, and drop when another one's task comes.
CACHES: list[dict] = []


def trim() -> None:
    """Drops what other tasks have left and gives free memory back to the system, as Python workers live on."""
    for cache in (*CACHES, _powers):
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 2)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word of a buffer that ends with a space."""
    inside = np.empty(len(a) + 1, bool)
    inside[0] = False
    np.not_equal(a, 32, out=inside[1:])
    inside[1:] &= (a - np.uint8(9)) > 4
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _blocks(buf: bytes) -> Iterator[tuple[int, int]]:
    """Cuts behind spaces, so that no word is cut; a block is longer than BLOCK only by a word."""
    at, end = 0, len(buf)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            cut = max(buf.rfind(bytes([c]), at, to) for c in SPACES)
            while cut < 0 and to < end:
                cut = min((x for c in SPACES if (x := buf.find(bytes([c]), to)) >= 0), default=end - 1)
            to = cut + 1
        yield at, to
        at = to


def hash_words(texts: Sequence[bytes | None], spans: bool = False):
    """Hashes of all words of the texts, and the number of words before each text (n + 1 numbers).

    With spans, the bytes of all texts and each word's first and past-last byte come too. A
    null text has no words.
    """
    buf = b" ".join(t or b"" for t in texts) + b" "
    hashes, starts, ends = [], [], []
    for lo, hi in _blocks(buf):
        a = np.frombuffer(buf, np.uint8, hi - lo, lo)
        s, e = _spans(a)
        p, q = powers(_BASE_BYTES, len(a) + 1)
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        x = a.astype(np.uint64)
        x += np.uint64(1)
        x *= p[: len(a)]
        np.cumsum(x, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * q[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    first = np.concatenate(starts) if starts else np.empty(0, np.int64)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.searchsorted(first, text_starts)
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    if spans:
        return words, bounds, buf, first, np.concatenate(ends) if ends else np.empty(0, np.int64)
    return words, bounds


def hash_runs(words: np.ndarray, length: int, base: int = _BASE_WORDS) -> np.ndarray:
    """The hash of words[i:i + length] for each i; runs may cross texts, the caller leaves those out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        w = words[at : min(at + BLOCK, n) + length - 1]
        p, q = powers(base, len(w) + 1)
        total = np.empty(len(w) + 1, np.uint64)
        total[0] = 0
        np.cumsum(w * p[: len(w)], out=total[1:])
        k = len(w) - length + 1
        out[at : at + k] = mix((total[length : length + k] - total[:k]) * q[:k])
    return out


def shingle_sets(texts: Sequence[bytes | None], k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of k words.

    A text of fewer words, but at least one, has its whole run of words as the only member.
    """
    words, bounds = hash_words(texts)
    runs = hash_runs(words, k)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            x = np.sort(runs[lo : hi - k + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            out.append(x)
        elif hi > lo:
            out.append(hash_runs(words[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sliced(texts: Sequence[bytes | None], size: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes each."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def parts_of(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PART bytes of texts (its column number at) each, so that no batch is held as Python objects."""
    lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= PART:
            yield batch.slice(first, i + 1 - first)
            first, total = i + 1, 0
    if first < batch.num_rows or not batch.num_rows:
        yield batch.slice(first)
