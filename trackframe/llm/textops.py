"""Vectorised handling of whole texts inside tasks.

A batch of texts is seen as one byte array with document offsets.  Words are
maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; as UTF-8 never
uses those bytes inside a character, they equal the words that the pattern
``[^\\x20\\x09-\\x0D]+`` finds in the decoded text.  Hashes are 64-bit
polynomials over a random byte table, finished by a bijective mixer; equal
strings have equal hashes and for n distinct strings a clash has a probability
of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .caches import release

#: Bytes of text that are worked on at once; arrays over them take about 50 times as much.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_OTHER_BASE = 0xD1B54A32D192ED03
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, SLICE_BYTES + 1), np.uint64)
        have[0], have[1:] = 1, np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(buf: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Running polynomial hash of a byte array; see :func:`span_hash`."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _power_table(base, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the bytes [start, end) of the array that ``prefix`` was made from (by the same base)."""
    inverse = _power_table(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def other_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes [start, end) of ``buf`` that is independent of :func:`span_hash`."""
    return span_hash(prefix_hash(buf, _OTHER_BASE), start, end, _OTHER_BASE)


class Texts:
    """Some whole texts of a batch: ``buf`` and ``offs`` (one more than there are texts)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the index of its first word (one more at the end)."""
        inside = ~SPACE[self.buf]
        before = np.empty(len(inside) + 1, bool)
        before[1:], before[0] = inside, False
        before[self.offs] = False
        start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(inside) + 1, bool)
        after[:-1], after[-1] = inside, False
        after[self.offs] = False
        end = np.flatnonzero(inside & ~after[1:]) + 1
        return start, end, np.searchsorted(start, self.offs)

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.buf], self.offs)


def slices(column: pa.ChunkedArray | pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a binary column of about ``size`` bytes each; a longer text makes a range of its own.

    Null counts as empty.  Caches that tasks of other operators left in this
    worker are freed.
    """
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, Texts(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (runs across texts included; callers mask them)."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hash[:n].copy()
    for k in range(1, width):
        out *= np.uint64(_BASE)
        out += word_hash[k : k + n]
    return mix(out)


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) by text."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
