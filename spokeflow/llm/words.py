"""Words of whole texts as NumPy arrays, straight from the bytes of an Arrow column.

All separators of the word rules used here are ASCII, so the words of a UTF-8 text are the words of its bytes. A rule is a
table of 256 flags. Texts are worked on in groups of about a megabyte, so memory does not depend on the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# Words between ASCII white space.
BETWEEN_SPACES = ~SPACE
# Words of digits, letters and everything beyond ASCII, after lower-casing A-Z.
LETTERS_DIGITS = np.array(
    [c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A for c in range(256)]
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0xD1342543DE82EF95
STEPS = _draw(64, 11) | np.uint64(1)
LENGTHS = np.arange(65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_powers = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(GROUP_BYTES.bit_length(), (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def byte_codes(is_word: np.ndarray, lower: bool = True) -> np.ndarray:
    """A random 64-bit code of each byte; zero for separators, the same for A-Z and a-z."""
    codes = _draw(256, 3)
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return np.where(is_word, codes, np.uint64(0))


def range_hashes(data: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes with a code from each start to the next one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.add.reduceat(codes[data] * _powers_of(BASE, len(data)), starts)
    return mix(sums * _powers_of(pow(BASE, -1, 1 << 64), len(data))[starts])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# Bytes 0 to n of a block of eight, little end first.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Longer words are rare and hashed one by one.
LONG_WORD = 1 << 10


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Blocks of eight bytes are mixed before they are added up, so no arrangement of bytes
    makes two ranges collide whatever the constants are, as it does with powers modulo 2 ** 64."""
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # The eight bytes from each place on.
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
    rows, at = np.arange(len(starts)), 0
    while len(rows):
        rows = rows[lengths[rows] > at]
        if at >= LONG_WORD:
            for row in rows.tolist():
                digest = hashlib.blake2b(data[starts[row] : ends[row]].tobytes(), digest_size=8).digest()
                out[row] = np.frombuffer(digest, "<u8")[0]
            break
        blocks = eight[starts[rows] + at] & MASKS[np.minimum(lengths[rows] - at, 8)]
        out[rows] += mix(blocks ^ _BLOCK[at // 8])
        at += 8
    return mix(out)


_BLOCK = _draw(LONG_WORD // 8, 29)


@dataclass
class Scan:
    """Words of the texts ``lo`` to ``hi``: byte ranges in ``data``, and where each text's words begin (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word."""
        return range_hashes(self.data, self.starts, codes)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word in lower case (A-Z), by blocks."""
        return block_hashes(LOWER[self.data], self.starts, self.ends)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; NULL is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize) if offsets else np.zeros(1, kind)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def groups(at: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text comes alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def scans(texts: pa.Array, is_word: np.ndarray) -> Iterator[Scan]:
    at, everything = buffers(texts)
    for lo, hi in groups(at):
        data = everything[at[lo] : at[hi]]
        text_at = (at[lo : hi + 1] - at[lo]).astype(np.int64)
        flags = is_word[data]
        # A text's end ends a word, whatever the next text begins with.
        edges = text_at[:-1][text_at[:-1] < text_at[1:]]
        begins = flags.copy()
        begins[1:] &= ~flags[:-1]
        begins[edges] = flags[edges]
        stops = flags.copy()
        stops[:-1] &= ~flags[1:]
        last = text_at[1:][text_at[:-1] < text_at[1:]] - 1
        stops[last] = flags[last]
        starts = np.flatnonzero(begins)
        yield Scan(lo, hi, data, text_at, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, text_at))


def shingles(scan: Scan, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and where each text's begin. A text of fewer words has one, of all."""
    counts = np.diff(scan.word_at)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        sums += words[j : j + len(sums)] * STEPS[j]
    # The j-th shingle of a text begins at its j-th word.
    first = np.repeat(scan.word_at[:-1] - at[:-1], n) + np.arange(at[-1])
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(counts >= k, n)
    out[full] = sums[first[full]] + LENGTHS[k]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        some = words[scan.word_at[i] : scan.word_at[i + 1]]
        out[at[i]] = np.add.reduce(np.append(some * STEPS[: len(some)], LENGTHS[len(some)]))
    return mix(out), at
