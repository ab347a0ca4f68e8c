"""Counts over whole texts, by numpy over slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .words import buffers, hashed, mix, white

SLICE = 4 << 20  # bytes of text worked on at once; a longer text is a slice of its own
WINDOW = 5  # words
SYMBOLS = b"#*$%&|<>"
_U = np.uint64


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts without nulls): record batches cut so that each holds about size bytes of text."""
    for b in batches:
        texts = b.column(b.schema.get_field_index(text))
        texts = texts.fill_null("") if texts.null_count else texts
        _, off = buffers(texts)
        i = 0
        while i < b.num_rows:
            j = min(b.num_rows, max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1))
            yield b.slice(i, j - i), texts.slice(i, j - i)
            i = j


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _LETTER, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)])), _table(bytes(range(48, 58)))
_ODD = _table(bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-()?"))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word of a slice, in order."""
    found = list(hashed(texts, lower))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate([x for x, _ in found]), np.concatenate([h for _, h in found])


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Arrays with a count for each text: words, characters of some kinds, repeated lines and repeated windows.

    Words and windows are compared by 64-bit hashes within a slice (two of a
    million windows are taken for one another with a chance under 1e-7).
    """
    n = len(texts)
    data, off = buffers(texts)
    b, off = data[off[0] : off[-1]], off - off[0]
    ws, low = white(b), (b & 0xC0) == 0x80
    c = {"n_bytes": off[1:] - off[:-1]}
    c["n_chars"] = c["n_bytes"] - _per_text(low, off)
    c["word_chars"] = _per_text(~ws & ~low, off)
    for name, t in (("n_symbols", _SYMBOL), ("upper", _UPPER), ("letters", _LETTER), ("digits", _DIGIT), ("odd", _ODD)):
        c[name] = _per_text(t[b], off)
    c["high"] = _per_text(b >= 128, off) - _per_text(low, off)
    at, h = word_hashes(texts)
    c["n_words"] = np.bincount(at, minlength=n)
    c["n_distinct"] = _distinct(at, h, n)
    same = (at[1:] == at[:-1]) & (h[1:] == h[:-1])
    c["n_adjacent"] = np.bincount(at[1:][same], minlength=n)
    c["n_repeat_words"] = _repeated(at, h, n)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = b.tobytes()
    for i in range(n):
        full = [x for x in whole[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    c["n_lines"], c["n_dup_lines"] = lines, dup
    return c


def _distinct(at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    key, first = np.unique(mix(h + mix(at.astype(_U) + _U(1))), return_index=True)
    return np.bincount(at[first], minlength=n)


def _repeated(at: np.ndarray, h: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words that lie in a window found twice or more in their text."""
    m = len(h) - window + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    key = mix(at[:m].astype(_U) + _U(1))
    for k in range(window):
        key = mix(key * _U(3) + h[k : k + m])
    inside = np.flatnonzero(at[:m] == at[window - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    s = key[order]
    equal = np.zeros(len(s) + 1, bool)
    equal[1:-1] = s[1:] == s[:-1]
    starts = order[equal[1:] | equal[:-1]]
    edge = np.bincount(starts, minlength=len(h) + 1) - np.bincount(starts + window, minlength=len(h) + 1)
    return np.bincount(at[np.cumsum(edge[:-1]) > 0], minlength=n)


def packed_sizes(texts: pa.Array, level: int = 3, chunk: int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Zstandard sizes of each whole text and, if chunk is given, of its chunks of so many bytes; then the texts' bytes.

    What is left after the full chunks counts as the text's last so many bytes; a text of less than a chunk has none.
    """
    z = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    whole, parts = np.zeros(len(texts), np.int64), []
    data, off = buffers(texts)
    for i in range(len(texts)):
        t = data[off[i] : off[i + 1]]
        whole[i] = len(z.compress(t))
        if chunk:
            at = [*range(0, len(t) - chunk + 1, chunk)]
            if at and len(t) % chunk:
                at.append(len(t) - chunk)
            parts.append(np.array([len(z.compress(t[k : k + chunk])) for k in at], np.int64))
    return whole, parts, np.diff(off)
