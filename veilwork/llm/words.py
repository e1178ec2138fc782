"""Vectorized words of a batch of texts: bounds, 64-bit hashes and rolling hashes.

A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. All texts of a batch lie in one
buffer, parted by a line feed, so numpy works on whole batches instead of single documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BATCH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= _C1
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words of a batch. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    def __init__(self, texts: list[bytes], space: np.ndarray = _SPACE, fold: np.ndarray | None = None):
        joined = b"\n".join(texts)
        self.raw = joined
        buf = np.frombuffer(joined + b"\n" + bytes(8), np.uint8)
        if fold is not None:
            buf = fold[buf]
        gap = space[buf[: len(joined) + 1]]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(edge) % 2 != (not gap[0]):  # cannot happen: the last byte is a gap
            raise AssertionError("unbalanced word bounds")
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.buf = buf
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        length = self.end - self.start
        at8 = np.ndarray((len(self.buf) - 7,), "<u8", buffer=self.buf, strides=(1,))
        h = at8[self.start] & _MASK[np.minimum(length, 8)]
        h = mix(h + length.astype(np.uint64) * _LEN)
        left, off = np.flatnonzero(length > 8), 8
        while len(left):
            v = at8[self.start[left] + off] & _MASK[np.minimum(length[left] - off, 8)]
            h[left] = mix((h[left] ^ v) * _STEP + np.uint64(off))
            off += 8
            left = left[length[left] > off]
        return h

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than ``n`` bytes (``n`` up to 8), and the hashes of their first ``n`` bytes."""
        at8 = np.ndarray((len(self.buf) - 7,), "<u8", buffer=self.buf, strides=(1,))
        long_ = np.flatnonzero(self.end - self.start > n)
        return long_, mix((at8[self.start[long_]] & _MASK[n]) + np.uint64((n + 64) * int(_LEN) % (1 << 64)))

    def whole(self, n: int) -> np.ndarray:
        """Starts ``i`` of which ``i .. i + n - 1`` are words of one text, as a mask over the words."""
        ok = np.ones(len(self), bool)
        for k in range(1, n):
            at = self.first[1:] - k
            ok[at[at >= self.first[:-1]]] = False
        return ok


class Rolling:
    """Hash of any run of words in constant time, from prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int = 0x2545F4914F6CDD1D):
        n = len(h) + 1
        power = np.full(n, base, np.uint64)
        power[0] = 1
        self.inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(h * power[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words ``start .. end - 1``."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words (those over the end of a text included)."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.inverse[:-n])


def batches(rows: Iterable[tuple[int, bytes]], limit: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cut a stream of (key, text) into batches of about ``limit`` bytes; a longer text is one batch."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for key, text in rows:
        if texts and size + len(text) > limit:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield keys, texts


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place = np.arange(len(values))
    span = 1
    while span < width:  # doubling; the last step may overlap
        step = min(span, width - span)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place
