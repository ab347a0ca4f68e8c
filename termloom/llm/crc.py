"""CRC-32C (Castagnoli) of many byte strings at once, and the mask that record files put on it."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 4096  # bytes; longer strings are cut into blocks whose checksums are combined


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(for each of four 16-bit parts of eight bytes, its effect on the state; the effect of BLOCK zero bytes on two 16-bit halves)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (t & np.uint32(1)))
    one = lambda c: (c >> np.uint32(8)) ^ t[c & np.uint32(255)]  # noqa: E731  a zero byte
    low, high = np.arange(1 << 16, dtype=np.uint32) & np.uint32(255), np.arange(1 << 16, dtype=np.uint32) >> np.uint32(8)
    pair = one(t[low]) ^ t[high]  # two bytes, then none
    parts = [pair]
    for _ in range(3):
        pair = one(one(pair))
        parts.append(pair)
    halves = []
    for k in (0, 16):
        c = np.array([1 << (k + i) for i in range(16)], np.uint32)
        for _ in range(BLOCK):
            c = one(c)
        v = np.zeros(1, np.uint32)
        for bit in c:
            v = np.concatenate([v, v ^ bit])
        halves.append(v)
    return np.stack(parts[::-1]), np.stack(halves)


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksum of each data[start : start + size] (data: uint8)."""
    parts, halves = _tables()
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    sizes = np.asarray(sizes, np.int64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    owner = np.repeat(np.arange(n), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lead = sizes - (blocks - 1) * BLOCK  # the first block is the short one, so that every later one is shifted alike
    size = np.where(rank == 0, lead[owner], BLOCK)
    at = np.asarray(starts, np.int64)[owner] + np.where(rank == 0, 0, lead[owner] + (rank - 1) * BLOCK)
    state = np.where(rank == 0, np.uint32(0xFFFFFFFF), np.uint32(0))
    order = np.argsort(-size, kind="stable")
    at, size, crc = at[order], size[order], state[order]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    m, f = len(size), np.uint64(0xFFFF)
    for k in range(0, int(size[0]) // 8):
        m = int(np.searchsorted(-size[:m], -8 * (k + 1), side="right"))
        x = words[at[:m] + 8 * k] ^ crc[:m]
        crc[:m] = parts[0][x & f] ^ parts[1][(x >> np.uint64(16)) & f] ^ parts[2][(x >> np.uint64(32)) & f] ^ parts[3][x >> np.uint64(48)]
    tail, done = size % 8, size - size % 8
    byte = _byte_table()
    for k in range(7):
        some = np.flatnonzero(tail > k)
        crc[some] = (crc[some] >> np.uint32(8)) ^ byte[(crc[some] ^ padded[at[some] + done[some] + k]) & np.uint32(255)]
    state[order] = crc
    first = np.cumsum(blocks) - blocks
    out = state[first]
    for r in range(1, int(blocks.max())):
        some = np.flatnonzero(blocks > r)
        out[some] = halves[0][out[some] & np.uint32(0xFFFF)] ^ halves[1][out[some] >> np.uint32(16)] ^ state[first[some] + r]
    return ~out


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (t & np.uint32(1)))
    return t


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that checksums of data that hold checksums stay good."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def masked_of(items: Sequence[bytes]) -> np.ndarray:
    """The masked checksum of each byte string."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    return masked(crc32c(np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes))
