"""Words of a batch of texts as numpy arrays, with memory bounded by the piece size.

A word is a run of bytes other than the six ASCII white-space bytes (0x20 and
0x09-0x0D), with A-Z lower-cased on request. Every function takes an Arrow
string array; null counts as the empty text. Long texts are cut at white
space into pieces of about PIECE bytes, so a text of any length is handled
whole in bounded memory (a single word longer than a piece stays whole).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(n, p, _U)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def white(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def spans(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in b; no word crosses a position in cuts."""
    w = ~white(b)
    edge = np.zeros(len(b) + 1, bool)
    edge[cuts] = True
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last[:-1] &= ~w[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(data: np.ndarray, off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(first text, one past the last, start byte, end byte); a long text comes in several pieces of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(off[i]), int(off[j])
        while hi - lo > size:  # only when it is one text
            at = lo + size
            while at < hi:
                hit = np.flatnonzero(white(data[at : min(at + 4096, hi)]))
                if len(hit):
                    at += int(hit[0])
                    break
                at = min(at + 4096, hi)
            yield i, j, lo, at
            lo = at
        yield i, j, lo, hi
        i = j


def hashed(texts: pa.Array, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece: the text's index and the 64-bit hash of every word, in order."""
    data, off = buffers(texts)
    for i, j, lo, hi in pieces(data, off):
        b = data[lo:hi]
        if lower:
            b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        cuts = np.clip(off[i : j + 1], lo, hi) - lo
        s, e = spans(b, cuts)
        up, down = powers(1 << max(20, int(len(b)).bit_length()))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(b.astype(_U) * up[: len(b)], out=total[1:])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        yield np.searchsorted(cuts, s, side="right") - 1 + i, h
