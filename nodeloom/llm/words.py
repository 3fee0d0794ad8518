"""Vectorised word kernels over Arrow batches.

Texts stay UTF-8 bytes; words, hashes and counts of many documents are found
with a few numpy passes. Memory is bounded: documents are taken in chunks of
about CHUNK bytes (a longer document is a chunk of its own) and bytes are
hashed in blocks of at most BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
BLOCK = 1 << 20

#: White space of the word contract: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is no word character of the licence contract: ASCII other than letters and digits.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (murmur3's public finaliser)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_P, _P_INV):
            steps = np.full(BLOCK + 1, base, _U)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are ordered and disjoint."""
    out = np.zeros(len(starts), _U)
    powers, inverse = _powers()
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        if int(ends[i]) - lo > BLOCK:  # one span longer than a block: fold its pieces
            edges = [*range(lo, int(ends[i]), BLOCK), int(ends[i])]
            h = 0
            for x, y in zip(edges, edges[1:], strict=False):
                h = (h * _P + int(hash_spans(b, np.array([x]), np.array([y]))[0])) % (1 << 64)
            out[i] = h
            i += 1
            continue
        hi = int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum((b[lo:hi].astype(_U) + _U(1)) * powers[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n consecutive items from each position on; the last n - 1 positions have none."""
    if len(h) < n:
        return np.zeros(0, _U)
    q = _U(0xC2B2AE3D27D4EB4F + 2 * seed)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * q + h[j : len(h) - n + 1 + j]
    return mix(out + _U(n * 1_000_003 + seed))


@dataclass
class Chunk:
    """Documents first..first + n of a batch, their bytes and their words."""

    first: int
    n: int
    b: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    edge: np.ndarray  # words of document i: edge[i]..edge[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.edge)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.b, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Positions of words at which a window of k words of one document starts."""
        if len(self.starts) < k:
            return np.zeros(0, np.int64)
        doc = self.doc
        return np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])

    def sum_bytes(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def cut(b: np.ndarray, off: np.ndarray, sep: np.ndarray, first: int = 0) -> Chunk:
    n = len(off) - 1
    inside = ~sep[b]
    full = np.flatnonzero(off[1:] > off[:-1])
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[full]] = False
    after[off[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Chunk(first, n, b, off, starts, ends, np.searchsorted(starts, off))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(texts: pa.Array, sep: np.ndarray = SPACE, lower: bool = False, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut the texts of a batch; null texts count as empty. lower: A-Z become a-z first."""
    if not len(texts):
        return
    data, off = _bytes(texts)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        b = data[off[i] : off[j]]
        if lower:
            b = b + (((b >= 65) & (b <= 90)) * np.uint8(32))
        yield cut(b, off[i : j + 1] - off[i], sep, i)
        i = j


def unique_per_doc(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, ascending within it, and where each document's begin."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    d, x = d[new], x[new]
    return x, np.searchsorted(d, np.arange(n + 1))


def fingerprint(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's hash list (order counts through the caller's sorting)."""
    place = np.arange(len(x)) - np.repeat(edge[:-1], np.diff(edge))
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(x * _U(seed) + mix(place.astype(_U) + _U(seed))), dtype=_U)])
        out.append(mix(sums[edge[1:]] - sums[edge[:-1]] + np.diff(edge).astype(_U)))
    return out[0], out[1]


def flags_cover(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n words are covered by windows of k words at the given starts."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


def lists(values: np.ndarray, edge: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
