"""Token ids of whole texts, with a bounded cache of encoded pieces.

The tokenizers library's BPE model encodes each distinct piece once (and again
after it has left the cache) instead of once for every occurrence. numpy cuts
a megabyte of text at a time into pieces, hashes them, and puts the ids of all
occurrences together; only new pieces reach the library, many in one call.

What a piece is. A chunk is a run of white space with what follows it up to the
next one. Chunks' ids make up the text's ids if the tokenizer's pieces take
white space only in front, or drop it; that is so for the two kinds of
pre-tokenizer that _kind() knows by their settings, and other files' texts are
encoded whole. In a chunk of ASCII and Latin-1 letters, ASCII digits and ASCII
marks without the apostrophe (which opens contractions) the tokenizer's own
pieces are plain to see: runs of one class. They go to the BPE model (_Joined).
Any other chunk is one piece and goes through the whole library. So does a
whole text with a special token's string, with white space outside ASCII, or
with separators on which libraries differ.

Special tokens' strings in a text become their ids, as the library has it; with
special_as_text they are ordinary text. Pieces are told apart by 64-bit
hashes, those over LONGEST bytes by place. Null texts are empty; texts of any
length are worked on in parts of about a megabyte, cut between chunks.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import buffers, mix, powers, white

CACHE = 600_000  # pieces at most
LONGEST, PART = 256, 1 << 20  # bytes of a piece that is kept; of text worked on at once
#: Characters that some libraries and not others count as white space or as word parts.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: The printable stand-in of each byte in byte-level vocabularies.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SEEN)}
_POINTS = np.array([ord(_BYTES[b]) for b in range(256)], "<u4")
_END = 0xE000  # and the byte: a symbol's last byte in a vocabulary of word ends
_OTHER, _LETTER, _DIGIT, _MARK, _WHITE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
for _b in range(128):
    _CLASS[_b] = _LETTER if chr(_b).isalpha() else _DIGIT if chr(_b).isdigit() else _WHITE if chr(_b) in "\t\n\v\f\r " else _MARK if 33 <= _b < 127 and _b != 39 else _OTHER
_U = np.uint64


def _kind(settings: dict) -> str | None:
    """"space" if pieces take one space in front, "drop" if white space is dropped and letters lower-cased, else None."""
    pre, norm = settings.get("pre_tokenizer") or {}, settings.get("normalizer")
    if settings.get("model", {}).get("type") != "BPE" or settings["model"].get("dropout"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "space"
    steps = [x.get("type") for x in pre.get("pretokenizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["Split", "ByteLevel"] and split.get("behavior") == "Removed" and split.get("invert") and [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "drop"
    return None


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range in turn."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Joined:
    """The library's BPE model over many pieces in one string, in which no merge crosses from one piece to the next.

    With a vocabulary of word ends, each symbol that ends a word stands as one
    character of its own, so ends can be seen in the ids; with any other, a
    byte that no merge has to do with stands after each piece.
    """

    TOGETHER = 64  # pieces in a string

    def __init__(self, model: dict):
        from tokenizers import Tokenizer, models

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        if model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback") or not all(c in vocab and c + suffix in vocab for c in _BYTES.values()):
            raise ValueError("no byte-level vocabulary of the known kinds")
        self.ends, self.after = np.zeros(max(vocab.values()) + 1, bool), None
        if suffix:
            byte = {c: b for b, c in _BYTES.items()}
            short = lambda t: t[: -len(suffix) - 1] + chr(_END + byte[t[-len(suffix) - 1]]) if t.endswith(suffix) and t[-len(suffix) - 1 : -len(suffix)] in byte else t
            self.ends[[i for t, i in vocab.items() if short(t) != t]] = True
            vocab, merges = {short(t): i for t, i in vocab.items()}, [(short(a), short(b)) for a, b in merges]
        else:
            used = {c for a, b in merges for c in a + b}
            self.after = next((c for c in _BYTES.values() if c not in used), None)
            if self.after is None:
                raise ValueError("every byte is in a merge")
            self.ends[vocab[self.after]] = True
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))

    def __call__(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of pieces whose bytes stand one after another in b, none of them empty."""
        if not len(size):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stop = np.cumsum(size)
        if self.after is None:
            points = _POINTS[b]
            points[stop - 1] = _END + b[stop - 1].astype("<u4")
        else:
            stop = stop + np.arange(1, len(size) + 1)
            points = np.full(int(stop[-1]), ord(self.after), "<u4")
            points[_ranges(stop - size - 1, size)] = _POINTS[b]
        whole = points.tobytes().decode("utf-32-le")
        cuts = [0, *stop[self.TOGETHER - 1 : -1 : self.TOGETHER].tolist(), int(stop[-1])]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.model.encode_batch_fast([whole[x:y] for x, y in zip(cuts, cuts[1:])], add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(size) or last[-1] != len(ids) - 1:
            raise AssertionError("the pieces of a joined string can't be told apart")
        many = np.diff(last, prepend=-1)
        return (ids, many) if self.after is None else (np.delete(ids, last), many - 1)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str, special_as_text: bool):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = special_as_text
    t.no_truncation()
    t.no_padding()
    return t


def _parts(b: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, one past the last, start byte, end byte): a long text comes in several parts, cut between chunks."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1))
        lo, hi = int(off[i]), int(off[j])
        while hi - lo > size:  # only when it is one text
            at = lo + size
            while at < hi:
                w = white(b[at - 1 : min(at + 4096, hi)])
                hit = np.flatnonzero(w[1:] & ~w[:-1])
                if len(hit):
                    at += int(hit[0])
                    break
                at = min(at + 4096, hi)
            if at >= hi:
                break
            yield i, j, lo, at
            lo = at
        yield i, j, lo, hi
        i = j


class Encoder:
    """Encodes texts to ids of width bytes each, little-endian."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = _tokenizer(path, special_as_text)
        settings = json.loads(self.tokenizer.to_str())
        self.kind, self.joined = _kind(settings), None
        self.code, self.width = ("H", 2) if self.tokenizer.get_vocab_size() <= 1 << 16 else ("I", 4)
        special = [] if special_as_text else [x["content"] for x in settings.get("added_tokens") or ()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.dtype = np.dtype(f"<u{self.width}")
        if self.kind:
            try:
                self.joined = _Joined(settings["model"])
            except ValueError:
                self.kind = None
        # the cache: hashes, ascending, and for each its row; rows say where a piece's ids lie in flat, and how often it came
        self.hashes, self.rows = np.zeros(0, _U), np.zeros(0, np.int64)
        self.start, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, self.dtype)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 1024) for e in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]

    def _cut(self, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, lower-cased where the tokenizer does so; start, end, and whether plain, of each piece). first: where texts begin."""
        n, kind = len(b), _CLASS[b]
        two = np.flatnonzero(b[:-1] == 0xC3)
        two = two[(b[two + 1] != 0x97) & (b[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = _LETTER
        ws = kind == _WHITE
        opens, closes = np.zeros(n, bool), np.zeros(n, bool)
        opens[first[first < n]] = True
        closes[first[(first > 0) & (first <= n)] - 1] = closes[-1] = True
        change = np.empty(n, bool)
        change[0], change[1:] = True, kind[1:] != kind[:-1]
        change |= opens
        after_white, before_text = np.empty(n, bool), np.empty(n, bool)
        after_white[0], after_white[1:] = False, ws[:-1]
        after_white &= ~opens
        before_text[-1], before_text[:-1] = False, ~ws[1:]
        before_text &= ~closes
        chunk = np.flatnonzero(opens | (ws & ~after_white))
        hard = np.add.reduceat(kind == _OTHER, chunk) > 0
        in_hard = np.repeat(hard, np.diff(np.append(chunk, n)))
        if self.kind == "space":
            start = np.where(ws, change | before_text, change & ~(after_white & (np.concatenate([[0], b[:-1]]) == 32)))
            start &= ~in_hard
            start[chunk] = True
            s = np.flatnonzero(start)
            return b, s, np.append(s[1:], n), ~in_hard[s]
        start = ~ws & np.where(in_hard, opens | after_white, change | (kind == _DIGIT))
        s = np.flatnonzero(start)
        ends = np.flatnonzero(~ws & np.append(ws[1:] | opens[1:] | (start[1:] & ~ws[1:]), True))
        low = b.copy()
        low[(b >= 65) & (b <= 90) & ~in_hard] += 32
        up = two[(b[two + 1] <= 0x9E) & ~in_hard[two]] + 1
        low[up] += 32
        return low, s, ends + 1, ~in_hard[s]

    def _new(self, b: np.ndarray, s: np.ndarray, e: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of new pieces; plain ones first."""
        size = e - s
        flat, many = self.joined(b[_ranges(s[plain], size[plain])], size[plain])
        if plain.all():
            return flat, many
        data = b.tobytes()
        rest = self._whole([data[x:y].decode() for x, y in zip(s[~plain].tolist(), e[~plain].tolist())])
        return np.concatenate([flat, *(np.array(x, np.int64) for x in rest)]), np.append(many, [len(x) for x in rest]).astype(np.int64)

    def _forget(self) -> None:
        """Halves the counts of uses and drops the pieces that have none left, and the rarest if these are still too many."""
        keep = self.uses > 1
        if np.count_nonzero(keep) > CACHE // 2:
            keep = np.zeros(len(self.uses), bool)
            keep[np.argpartition(self.uses, -(CACHE // 2))[-(CACHE // 2) :]] = True
        of = np.cumsum(keep) - 1
        left = keep[self.rows]
        self.hashes, self.rows = self.hashes[left], of[self.rows[left]]
        self.flat = self.flat[_ranges(self.start[keep], self.size[keep])]
        self.size, self.uses = self.size[keep], self.uses[keep] >> 1
        self.start = np.cumsum(self.size) - self.size

    def _part(self, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each text has) of a part; first: where its texts begin, and its end."""
        if not len(b):
            return np.zeros(0, self.dtype), np.zeros(len(first) - 1, np.int64)
        b, s, e, plain = self._cut(b, first)
        up, down = powers(1 << max(20, len(b).bit_length()))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(b * up[: len(b)], out=total[1:])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93) + plain)
        long = np.flatnonzero(e - s > LONGEST)
        h[long] = long.astype(_U) << _U(40)  # by place: such a piece isn't kept
        distinct, of, count = np.unique(h, return_inverse=True, return_counts=True)
        if len(self.hashes) + len(distinct) > CACHE:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        hit = self.hashes[np.minimum(at, max(0, len(self.hashes) - 1))] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        some = np.empty(len(distinct), np.int64)
        some[of] = np.arange(len(h))
        row = np.empty(len(distinct), np.int64)
        row[hit] = self.rows[at[hit]]
        self.uses[row[hit]] += count[hit]
        new = np.flatnonzero(~hit)
        if len(new):
            x = some[new]
            order = np.argsort(~plain[x], kind="stable")
            new, x = new[order], x[order]
            ids, many = self._new(b, s[x], e[x], plain[x])
            row[new] = len(self.size) + np.arange(len(new))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(many) - many)
            self.flat, self.size, self.uses = np.append(self.flat, ids.astype(self.dtype)), np.append(self.size, many), np.append(self.uses, count[new])
            new.sort()
            kept = new[e[some[new]] - s[some[new]] <= LONGEST]
            self.hashes, self.rows = np.insert(self.hashes, at[kept], distinct[kept]), np.insert(self.rows, at[kept], row[kept])
        mine = row[of]
        many = self.size[mine]
        before = np.append(0, np.cumsum(many))
        return self.flat[_ranges(self.start[mine], many)], np.diff(before[np.searchsorted(s, first)])

    def _odd(self, texts: pa.Array, b: np.ndarray, off: np.ndarray) -> list[int]:
        """The texts that only the whole library takes apart rightly."""
        control = (b >= 0x1C) & (b < 0x20)
        if not (self.special or control.any() or (b >= 0xC2).any()):
            return []
        some = np.zeros(len(b) + 1, np.int64)
        # the characters of _ODD and no letters of Latin-1: two bytes after C2, three after E1, E2, E3 and EF
        np.cumsum(control | (b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)) | (b == 0xEF), out=some[1:])
        found = {i for i in np.flatnonzero(some[off[1:]] > some[off[:-1]]).tolist() if _ODD.search(texts[i].as_py())}
        if self.special and self.special.search(b.tobytes().decode()):
            found |= {i for i in range(len(texts)) if self.special.search(texts[i].as_py())}
        return sorted(found)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("") if texts.null_count else texts
        if self.kind is None:
            return [array(self.code, x).tobytes() for x in self._whole(texts.to_pylist())]
        data, off = buffers(texts)
        b, off = data[off[0] : off[-1]], off - off[0]
        odd = self._odd(texts, b, off)
        if odd:
            whole = dict(zip(odd, self._whole([texts[i].as_py() for i in odd])))
            rest = iter(self.encode(texts.filter(pa.array([i not in whole for i in range(len(texts))]))))
            return [array(self.code, whole[i]).tobytes() if i in whole else next(rest) for i in range(len(texts))]
        out: list[bytes] = [b""] * len(texts)
        for i, j, lo, hi in _parts(b, off, PART):
            ids, many = self._part(b[lo:hi], np.clip(off[i : j + 1], lo, hi) - lo)
            packed, stop = ids.tobytes(), (np.append(0, np.cumsum(many)) * self.width).tolist()
            for k in range(i, j):
                out[k] += packed[stop[k - i] : stop[k - i + 1]]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This process's encoder of a tokenizer file; it keeps its cache between tasks."""
    return Encoder(path, special_as_text)
