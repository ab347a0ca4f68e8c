"""Interpolated modified Kneser-Ney model of any order, counted in Spark and scored from memory-mapped hash arrays.

Numbers. Training texts become arrays of 64-bit word hashes; each task adds up
what it has read and sends every shard (a range of hashes) one block of sorted
hashes and counts. A shard's merge writes a sorted array to the shared folder.
A word's place in the vocabulary so written is its number. An n-gram is the
pair of two numbers, of its first and of its last n-1 words; scattered by a
bijection of the numbers' bits, the pair is its hash, so n-grams of every order
are exact, spread evenly however frequent a word is, and can be taken apart
again. Below the highest order its place among all of its order is an n-gram's
number. A hash is its shard and the rest, so that numbers of any size will do.

Sums. The merge of a shard of the highest order adds up, for each n-gram of the
order below, what it is followed and preceded by; these sums, pre-aggregated,
make the context arrays. The numbers of distinct words before then stand for
the counts of that order, and give the sums of the next lower one.

Size. Sorted hashes are kept as their low bytes and, for the high bits, how many
share them (blocks: a bitmap; arrays: where each begins), counts in half a
byte. A task sends blocks to FAN ranges at most; where there are more shards,
the ranges' tasks add blocks up and send them on to their parts, and so on, so
that the blocks are in proportion to the text. Shuffle files of a pass that is
over are removed.

Model. Counts have discounts D1, D2, D3+ from their counts of counts, each
order its own, and below is a uniform share for each known word and one for
all unknown ones (h: a context, h': the same without its first word):

    p(w)     = max(0, a(w) - D(a(w))) / A + g / (V + 1)
    p(w | h) = max(0, c(h, w) - D(c(h, w))) / c(h) + g(h) p(w | h')

c: the count in the highest order, the number of distinct words before in the
others; a(w): distinct words before w, A: their sum, g: what discounting took.
A text is scored from its beginning (order - 1 tokens that stand only there)
to its end, a token.

Scoring. A worker maps the arrays (pages that it touches are read, and shared
by all workers of a machine) and looks up the sorted distinct words and
n-grams of a few megabytes of text at a time by binary search. From a store
that isn't mounted it reads whole arrays and keeps HELD bytes of them.

Edge cases: null and empty texts have the end token only; a null id is not
held out; repeated rows count each time; very long texts are worked on a
megabyte at a time where words are counted, and as a whole where n-grams are;
without training texts every token is unknown and has probability
1 / (V + 1) = 1; other columns are ignored. An array that the model has and the
folder hasn't is an error.
"""

from __future__ import annotations

import functools
import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Store, folder, tidy
from .textstats import slices
from .words import hashed, mix

TOKENS = 4 << 20  # tokens that a task adds up before it sends blocks on
WORD_SHARD, PAIR_SHARD, PAIRS_PER_CONTEXT = 64 << 20, 16 << 20, 16  # bytes of text for each shard; bigram shards for each context shard
GRAMS_PER_CONTEXT = 4  # the same where contexts have two words or more, which are many
FAN_BITS = 8  # FAN = 256
HELD = 256 << 20  # bytes of arrays that a worker keeps from a store that isn't mounted
ORDER = 3  # of the registered query
_U = np.uint64
_END = _U(0xA5B35705F00DC0DE)  # the end token's hash


# --- hashes of pairs ------------------------------------------------------------


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _stir(x: np.ndarray, turn: int, bits: int) -> np.ndarray:
    return mix(x + _U(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)) >> _U(64 - bits)


_TURNS = 3


def scattered(u: np.ndarray, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of numbers of so many bits (1 to 63) each."""
    for k in range(_TURNS):
        u = u ^ _stir(v, 2 * k + 1, bits)
        v = v ^ _stir(u, 2 * k + 2, bits)
    return u, v


def collected(u: np.ndarray, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of scattered."""
    for k in reversed(range(_TURNS)):
        v = v ^ _stir(u, 2 * k + 2, bits)
        u = u ^ _stir(v, 2 * k + 1, bits)
    return u, v


@dataclass(frozen=True)
class Space:
    """Hashes as (shard, rest), of so many bits; rest has 64 at most."""

    shard: int
    rest: int
    half: int = 0  # bits of each number of a pair

    def split(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of numbers."""
        u, v = scattered(u.astype(_U), v.astype(_U), self.half)
        low = self.half - self.shard
        return u >> _U(low), ((u & _mask(low)) << _U(self.half)) | v

    def pair(self, shard: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (_U(shard) << _U(self.half - self.shard)) | (rest >> _U(self.half))
        return collected(u, rest & _mask(self.half), self.half)

    def prefix(self, shard: np.ndarray, rest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(the first bits, the others), of which there must be 64 at most."""
        over = self.shard - bits
        return shard >> _U(over), ((shard & _mask(over)) << _U(self.rest)) | rest if over else rest

    def steps(self) -> list[int]:
        """The bits by which blocks are dealt, pass by pass."""
        out = [min(self.shard, max(FAN_BITS, self.shard + self.rest - 64))]
        while out[-1] < self.shard:
            out.append(min(self.shard, out[-1] + FAN_BITS))
        return out


def _order(shard: np.ndarray, rest: np.ndarray, space: Space) -> np.ndarray:
    if space.shard + space.rest <= 64:
        return np.argsort((shard << _U(space.rest)) | rest if space.shard else rest, kind="stable")
    return np.lexsort((rest, shard))


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = False
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return new


def add_up(shard: np.ndarray, rest: np.ndarray, space: Space, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts (one each, if none are given)."""
    if not len(rest):
        return shard, rest, np.zeros(0, np.int64)
    if counts is None and space.shard + space.rest <= 64:
        key = np.sort((shard << _U(space.rest)) | rest if space.shard else rest)
        at = np.flatnonzero(_firsts(key))
        key, counts = key[at], np.diff(np.append(at, len(key)))
        return (key >> _U(space.rest), key & _mask(space.rest), counts) if space.shard else (np.zeros(len(key), _U), key, counts)
    order = _order(shard, rest, space)
    shard, rest = shard[order], rest[order]
    at = np.flatnonzero(_firsts(shard, rest))
    return shard[at], rest[at], np.diff(np.append(at, len(rest))) if counts is None else np.add.reduceat(counts[order], at)


# --- packed numbers -------------------------------------------------------------------


def packed(keys: np.ndarray, bits: int) -> bytes:
    """Sorted numbers of so many bits: low bytes, and a bitmap in which a number's place tells its high bits."""
    n = len(keys)
    width = max(0, -(-(bits - max(0, n.bit_length() - 1)) // 8))
    high = max(0, bits - 8 * width)
    at = np.zeros(n + (1 << high), bool)
    at[(keys >> _U(8 * width)).astype(np.int64) + np.arange(n) if width < 8 else np.arange(n)] = True
    low = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return n.to_bytes(6, "little") + bytes([width, high]) + low.tobytes() + np.packbits(at).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, width, high = int.from_bytes(data[:6], "little"), data[6], data[7]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 8).reshape(n, width)
    out = out.reshape(-1).view("<u8").astype(_U)
    if width < 8:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + n * width), count=n + (1 << high)))
        out |= (at - np.arange(n)).astype(_U) << _U(8 * width)
    return out


def _small(counts: np.ndarray) -> bytes:
    """Counts in half a byte each, 15 for larger ones; then the larger ones' places and counts, how many there are, and how many in all."""
    large, n = np.flatnonzero(counts >= 15), len(counts)
    half = np.zeros(n + n % 2, np.uint8)
    half[:n] = np.minimum(counts, 15)
    return b"".join([(half[::2] | half[1::2] << 4).tobytes(), large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes(), len(large).to_bytes(8, "little"), n.to_bytes(8, "little")])


def _counts(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """What _small() has packed: all counts, or those at some places."""
    many, n = np.frombuffer(data[-16:].tobytes(), "<i8").tolist()
    half = data[: (n + 1) // 2]
    if at is None:
        got = np.empty(2 * len(half), np.int64)
        got[::2], got[1::2] = half & 15, half >> 4
        got = got[:n]
    else:
        got = ((half[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15).astype(np.int64)
    if many:
        start = len(half)
        places, values = np.frombuffer(data[start : start + 4 * many].tobytes(), "<u4"), np.frombuffer(data[start + 4 * many : -16].tobytes(), "<i8")
        big = np.flatnonzero(got == 15)
        got[big] = values[np.searchsorted(places, big if at is None else at[big])]
    return got


def _array(rest: np.ndarray, bits: int) -> list[bytes]:
    """A sorted hash array as a file: low halves and where each high half begins, if these are few; else the numbers."""
    n = len(rest)
    high = bits - 32 if bits <= 32 or 1 << (bits - 32) <= max(1024, n) else -1
    if high < 0 and bits > 32:
        return [rest.astype("<u8").tobytes(), np.array([n, 0, 8], "<i8").tobytes()]
    high = max(0, high)
    starts = np.searchsorted(rest >> _U(32), np.arange((1 << high) + 1, dtype=_U))
    return [(rest & _mask(32)).astype("<u4").tobytes(), starts.astype("<u4").tobytes(), np.array([n, len(starts), 4], "<i8").tobytes()]


def _opened(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    n, starts, width = np.frombuffer(data[-24:].tobytes(), "<i8").tolist()
    body = data[: len(data) - 24]
    return body[: n * width].view(f"<u{width}"), body[n * width :].view("<u4") if starts else None


def _all(data: np.ndarray) -> np.ndarray:
    low, starts = _opened(data)
    if starts is None:
        return np.array(low, _U)
    return (np.repeat(np.arange(len(starts) - 1, dtype=_U), np.diff(starts.astype(np.int64))) << _U(32)) | low


def _places(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each of some sorted numbers is in an array, -1 if it isn't."""
    low, starts = _opened(data)
    if not (len(low) and len(keys)):
        return np.full(len(keys), -1, np.int64)
    if starts is None:
        at = np.searchsorted(low, keys)
        want = keys
    else:
        want, top = (keys & _mask(32)).astype("<u4"), (keys >> _U(32)).astype(np.int64)
        at, hi = starts[top].astype(np.int64), starts[top + 1].astype(np.int64)
        end = hi
        for _ in range(int((hi - at).max()).bit_length()):
            mid = np.minimum((at + hi) >> 1, len(low) - 1)
            less = (at < hi) & (low[mid] < want)
            at, hi = np.where(less, mid + 1, at), np.where(less, hi, mid)
        at = np.where(at < end, at, len(low))
    there = np.minimum(at, len(low) - 1)
    return np.where((at < len(low)) & (low[there] == want), there, -1)


# --- the model's files ------------------------------------------------------------------


@dataclass
class Arrays:
    """Where the model lies, and its few sums. Lists by order begin with the words'; sizes of shards are files."""

    uri: str
    order: int = 2
    word_bits: int = 0
    pair_bits: int = 0
    grams: list[int] = field(default_factory=list)  # by order: distinct n-grams
    contexts: list[int] = field(default_factory=list)  # by order below the highest: n-grams in each context shard
    tokens: int = 0
    pairs: int = 0
    discounts: list[tuple[float, ...]] = field(default_factory=list)  # by order
    left: float = 0.0  # what the discounts of unigrams leave

    def many(self, n: int) -> int:
        """Distinct n-grams; also the number of the one that is all beginning."""
        return self.grams[n - 1]

    @property
    def vocabulary(self) -> int:
        return self.many(1)

    def space(self, n: int) -> Space:
        if n == 1:
            return Space(self.word_bits, 64 - self.word_bits)
        half = max(1, self.many(n - 1).bit_length())
        shard = max(min(self.pair_bits, half), 2 * half - 64)
        return Space(shard, 2 * half - shard, half)


_held: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


@functools.lru_cache(maxsize=512)
def _mapped(uri: str, name: str) -> np.ndarray:
    return np.memmap(f"{Store(uri).path}/{name}", np.uint8, "r")


def _bytes(uri: str, name: str) -> np.ndarray:
    """A file's bytes: mapped, or read whole from a store that isn't mounted."""
    store = Store(uri)
    if store.path is not None:
        return _mapped(uri, name)
    if (uri, name) in _held:
        _held.move_to_end((uri, name))
        return _held[uri, name]
    with store.open(name) as f:
        data = np.frombuffer(f.read(), np.uint8)
    _held[uri, name] = data
    while len(_held) > 1 and sum(x.nbytes for x in _held.values()) > HELD:
        _held.popitem(last=False)
    return data


def _before_shards(m: Arrays, n: int) -> np.ndarray:
    """How many n-grams the shards before each have, and all."""
    return _bytes(m.uri, f"before{n}").view("<i8")


def _gram_file(n: int, shard: int) -> str:
    return f"gram{n}-{shard:07d}"


def _find(m: Arrays, n: int, shard: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number or -1, count or 0) of each of the sorted distinct hashes of n-grams; counts for words and the highest order."""
    place, count = np.full(len(rest), -1, np.int64), np.zeros(len(rest), np.int64)
    if not len(rest) or not m.many(n):
        return place, count
    before = _before_shards(m, n)
    cuts = np.flatnonzero(_firsts(shard))
    for s, a, b in zip(shard[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
        if before[s + 1] > before[s]:
            at = _places(_bytes(m.uri, _gram_file(n, s)), rest[a:b])
            hit = at >= 0
            place[a:b] = np.where(hit, before[s] + at, -1)
            if n == 1 or n == m.order:
                count[a:b][hit] = _counts(_bytes(m.uri, f"{_gram_file(n, s)}.counts"), at[hit])
    return place, count


# --- tokens and their numbers --------------------------------------------------------------


def _token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of all tokens, each text's end token last."""
    parts = list(hashed(texts, lower=True))
    at = np.concatenate([*(a for a, _ in parts), np.arange(len(texts))])
    h = np.concatenate([*(x for _, x in parts), np.full(len(texts), _END)])
    order = np.argsort(at, kind="stable")
    return at[order], h[order]


def _starts(at: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], at[1:] != at[:-1]])


def _before(numbers: np.ndarray, starts: np.ndarray, beginning: int) -> np.ndarray:
    """The number of the n-gram that ends a token earlier."""
    before = np.concatenate([[0], numbers[:-1]])
    before[starts] = beginning
    return before


def _found(m: Arrays, n: int, shard: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_find() for hashes in any order, with repeats."""
    if not len(rest):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _order(shard, rest, m.space(n))
    shard, rest = shard[order], rest[order]
    new = _firsts(shard, rest)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    place, count = _find(m, n, shard[new], rest[new])
    return place[of], count[of]


def _look_up(m: Arrays, n: int, before: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, count) for every token, whatever is unknown in the order below."""
    place, count = np.full(len(numbers), -1, np.int64), np.zeros(len(numbers), np.int64)
    known = (before >= 0) & (numbers >= 0)
    place[known], count[known] = _found(m, n, *m.space(n).split(before[known], numbers[known]))
    return place, count


def _numbered(m: Arrays, at: np.ndarray, h: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each order up to one: the number, or -1, of the n-gram that ends at each token; the words' counts)."""
    bits = m.space(1).rest
    place, count = _found(m, 1, h >> _U(bits) if bits < 64 else np.zeros(len(h), _U), h & _mask(bits))
    out, starts = [place], _starts(at)
    for n in range(2, order + 1):
        out.append(_look_up(m, n, _before(out[-1], starts, m.many(n - 1)), out[-1])[0])
    return out, count


# --- counting ----------------------------------------------------------------------------


_BLOCK = "shard long, keys binary, counts binary"


def _blocks(shard: np.ndarray, rest: np.ndarray, counts: np.ndarray | None, space: Space, bits: int) -> pa.RecordBatch:
    """A row for each range of hashes (their first bits) that gets any of the sorted ones."""
    to, low = space.prefix(shard, rest, bits)
    cuts = np.flatnonzero(_firsts(to)).tolist() if len(to) else []
    spans = list(zip(cuts, [*cuts[1:], len(to)]))
    left = space.shard + space.rest - bits
    return pa.RecordBatch.from_pydict(
        {"shard": pa.array(to[cuts].astype(np.int64), pa.int64()), "keys": pa.array([packed(low[a:b], left) for a, b in spans], pa.binary()), "counts": pa.array([b"" if counts is None else _small(counts[a:b]) for a, b in spans], pa.binary())}
    )


def _count(grams: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], space: Space, counted: bool):
    """Blocks of the hashes that grams finds in texts."""
    bits = space.steps()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            shard, rest, counts = add_up(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), space)
            held.clear()
            return _blocks(shard, rest, counts if counted else None, space, bits)

        for _, texts in slices(batches):
            held.append(grams(texts))
            if sum(len(x) for x, _ in held) >= TOKENS:
                yield block()
        if held:
            yield block()

    return run


def _read_blocks(keys: list[bytes], counts: list[bytes], space: Space, bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Blocks of one range added up."""
    low = np.concatenate([unpacked(x) for x in keys])
    over = space.shard - bits
    of = (_U(shard) << _U(over)) | (low >> _U(space.rest)) if over else np.full(len(low), shard, _U)
    counted = bool(counts[0])
    got = add_up(of, low & _mask(space.rest), space, np.concatenate([_counts(np.frombuffer(x, np.uint8)) for x in counts]) if counted else None)
    return got[0], got[1], got[2] if counted else None


def _deal(space: Space, bits: int, then: int):
    """Adds up the blocks of each range, which come one range after another, and cuts them into finer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        now, some = None, 0
        for b in batches:
            for shard, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
                if held[0] and (shard != now or some >= TOKENS):
                    yield _blocks(*_read_blocks(*held, space, bits, now), space, then)
                    held, some = ([], []), 0
                held[0].append(keys)
                held[1].append(counts)
                now, some = shard, some + int.from_bytes(keys[:6], "little")
        if held[0]:
            yield _blocks(*_read_blocks(*held, space, bits, now), space, then)

    return run


def _dealt(blocks: DataFrame, space: Space) -> DataFrame:
    """Blocks by shard, from those by the first bits."""
    steps = space.steps()
    for bits, then in zip(steps, steps[1:]):
        blocks = blocks.repartition(1 << min(bits, 16), "shard").sortWithinPartitions("shard").mapInArrow(_deal(space, bits, then), _BLOCK)
    return blocks


def _write(uri: str, n: int, shard: int, rest: np.ndarray, counts: np.ndarray | None, space: Space) -> None:
    store = Store(uri)
    if counts is not None:
        store.write(f"{_gram_file(n, shard)}.counts", [_small(counts)])
    store.write(_gram_file(n, shard), _array(rest, space.rest))


def _write_grams(m: Arrays, n: int, space: Space):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        _, rest, counts = _read_blocks(group["keys"].to_pylist(), group["counts"].to_pylist(), space, space.shard, shard)
        _write(m.uri, n, shard, rest, counts, space)
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(rest)], pa.int64()), "tokens": pa.array([0 if counts is None else int(counts.sum())], pa.int64())})

    return run


def _words_of(m: Arrays) -> Callable:
    bits = m.space(1).rest

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h = _token_hashes(texts)[1]
        return (h >> _U(bits) if bits < 64 else np.zeros(len(h), _U)), h & _mask(bits)

    return run


def _grams_of(m: Arrays, n: int) -> Callable:
    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, h = _token_hashes(texts)
        numbers = _numbered(m, at, h, n - 1)[0][-1]
        return m.space(n).split(_before(numbers, _starts(at), m.many(n - 1)), numbers)

    return run


# --- sums and contexts ---------------------------------------------------------------------

_OF_CONTEXT = ("total", "ones", "twos", "more")
_TALLY = ("n1", "n2", "n3", "n4", "grams")
_SUMS = f"range long, ids binary, {', '.join(f'{c} binary' for c in _OF_CONTEXT)}, after binary, before binary, {', '.join(f'{c} long' for c in _TALLY)}"


def _spans(m: Arrays, n: int) -> list[int]:
    """How many numbers of n-grams the blocks of each pass span, the last those of a context shard."""
    out = [m.contexts[n - 1]]
    while m.many(n) // out[-1] >= 1 << FAN_BITS:
        out.append(out[-1] << FAN_BITS)
    return out[::-1]


def _sum_blocks(span: int, ids: np.ndarray, sums: list[np.ndarray], after: np.ndarray, before: np.ndarray, tally: list[int]) -> dict[str, pa.Array]:
    """A row for each span of numbers: ids are followed (by distinct words, with the sums of their counts), after are preceded."""
    a, b = ids // span, after // span
    some = np.union1d(a, b)
    cuts = [[np.searchsorted(x, some, side=side).tolist() for side in ("left", "right")] for x in (a, b)]
    bits = span.bit_length()
    key = lambda x, r: packed((x - r * span).astype(_U), bits) if len(x) else b""
    own, of = (list(zip(some.tolist(), *c)) for c in cuts)
    cols = {"range": pa.array(some, pa.int64()), "ids": pa.array([key(ids[x:y], r) for r, x, y in own], pa.binary())}
    cols |= {c: pa.array([_small(s[x:y]) for _, x, y in own], pa.binary()) for c, s in zip(_OF_CONTEXT, sums)}
    cols |= {"after": pa.array([key(after[x:y], r) for r, x, y in of], pa.binary()), "before": pa.array([_small(before[x:y]) for _, x, y in of], pa.binary())}
    return cols | {c: pa.array([t] + [0] * (len(some) - 1) if len(some) else [], pa.int64()) for c, t in zip(_TALLY, tally)}


def _sums(m: Arrays, n: int, span: int, shard: int, rest: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    """What the n-grams of a shard add to the sums of those one word shorter."""
    u, w = (x.astype(np.int64) for x in m.space(n).pair(shard, rest))
    ids, iu = np.unique(u, return_inverse=True)
    after, before = np.unique(w, return_counts=True)
    sums = [np.bincount(iu, counts, len(ids)).astype(np.int64), *(np.bincount(iu[x], minlength=len(ids)) for x in (counts == 1, counts == 2, counts > 2))]
    return _sum_blocks(span, ids, sums, after, before, [*(int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)), len(rest)])


def _write_highest(m: Arrays):
    space, span = m.space(m.order), _spans(m, m.order - 1)[0]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        _, rest, counts = _read_blocks(group["keys"].to_pylist(), group["counts"].to_pylist(), space, space.shard, shard)
        _write(m.uri, m.order, shard, rest, counts, space)
        return pa.table(_sums(m, m.order, span, shard, rest, counts))

    return run


def _read_grams(m: Arrays, n: int):
    """The sums of n-grams below the highest order, whose counts are the numbers of distinct words before."""
    span = _spans(m, n - 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = _before_shards(m, n)
        for b in batches:
            for shard in b.column(0).to_pylist():
                if before[shard + 1] > before[shard]:
                    rest = _all(_bytes(m.uri, _gram_file(n, shard)))
                    yield pa.RecordBatch.from_pydict(_sums(m, n, span, shard, rest, _context(m, n, np.arange(before[shard], before[shard + 1]))[4]))

    return run


def _deal_sums(span: int, then: int):
    """Adds up the sums of each range, which come one after another, and cuts them into finer ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        some = 0

        def added(keys: str, values: tuple[str, ...], base: int) -> tuple[np.ndarray, list[np.ndarray]]:
            rows = [r for r in held if r[keys]]
            if not rows:
                return np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in values]
            ids = np.concatenate([unpacked(r[keys]) for r in rows]).astype(np.int64) + base
            order = np.argsort(ids, kind="stable")
            at = np.flatnonzero(_firsts(ids[order]))
            return ids[order][at], [np.add.reduceat(np.concatenate([_counts(np.frombuffer(r[c], np.uint8)) for r in rows])[order], at) for c in values]

        def blocks() -> pa.RecordBatch:
            base = held[0]["range"] * span
            ids, sums = added("ids", _OF_CONTEXT, base)
            after, (before,) = added("after", ("before",), base)
            tally = [sum(r[c] for r in held) for c in _TALLY]
            held.clear()
            return pa.RecordBatch.from_pydict(_sum_blocks(then, ids, sums, after, before, tally))

        for b in batches:
            for r in b.to_pylist():
                if held and (r["range"] != held[0]["range"] or some >= TOKENS):
                    yield blocks()
                    some = 0
                held.append(r)
                some += sum(int.from_bytes(r[c][:6], "little") for c in ("ids", "after"))
        if held:
            yield blocks()

    return run


def _write_contexts(m: Arrays, n: int):
    """The context arrays of n-grams, from the sums that those one word longer have sent; returns their tallies and its own."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        r = key[0].as_py()
        out = [np.zeros(min(m.contexts[n - 1], m.many(n) + 1 - r * m.contexts[n - 1]), np.int64) for _ in range(5)]
        for ids, *sums, after, before in zip(*(group[c].to_pylist() for c in ("ids", *_OF_CONTEXT, "after", "before"))):
            if ids:
                at = unpacked(ids).astype(np.int64)
                for o, s in zip(out, sums):
                    o[at] += _counts(np.frombuffer(s, np.uint8))
            if after:
                out[4][unpacked(after).astype(np.int64)] += _counts(np.frombuffer(before, np.uint8))
        parts = [_small(x) for x in out]
        Store(m.uri).write(f"context{n}-{r:07d}", [*parts, *(len(x).to_bytes(8, "little") for x in parts)])
        row = {c: pa.array([int(np.sum(group[c].to_numpy()))], pa.int64()) for c in _TALLY}
        row |= {f"a{k}": pa.array([int(np.count_nonzero(out[4] == k))], pa.int64()) for k in (1, 2, 3, 4)}
        return pa.table(row | {"a3p": pa.array([int(np.count_nonzero(out[4] >= 3))], pa.int64())})

    return run


def _context(m: Arrays, n: int, ids: np.ndarray) -> np.ndarray:
    """Five rows of sums for numbers of n-grams (-1: zeros)."""
    if not m.tokens:
        return np.zeros((5, len(ids)), np.int64)
    distinct, inverse = np.unique(ids, return_inverse=True)
    out, per = np.zeros((5, len(distinct)), np.int64), m.contexts[n - 1]
    for r in np.unique(distinct[distinct >= 0] // per).tolist():
        a, b = np.searchsorted(distinct, [max(0, r * per), (r + 1) * per])
        data, end = _bytes(m.uri, f"context{n}-{r:07d}"), 0
        for k, length in enumerate(np.frombuffer(data[-40:].tobytes(), "<i8").tolist()):
            out[k, a:b] = _counts(data[end : end + length], distinct[a:b] - r * per)
            end += length
    return out[:, inverse]


# --- training and scoring ----------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of items counted once to four times; halves where a number is missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k, max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))  # type: ignore[return-value]


def _number(m: Arrays, n: int, sizes: dict[int, int], per: int) -> None:
    """Notes how many n-grams the shards have, in a file, and how many share a context shard."""
    each = np.zeros(1 << m.space(n).shard, "<i8")
    each[list(sizes)] = list(sizes.values())
    Store(m.uri).write(f"before{n}", [np.append(0, np.cumsum(each)).astype("<i8").tobytes()])
    m.grams.append(int(each.sum()))
    if n < m.order:  # context shards keep pace with the shards that send to them, so that each gathers as much at every size
        m.contexts.append(-(-(m.many(n) + 1) // max(1, (1 << m.pair_bits) // per)))


def _sizes_of(m: Arrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for shard in b.column(0).to_pylist():
                try:
                    with Store(m.uri).open(_gram_file(m.order, shard)) as f:
                        f.seek(f.size() - 24)
                        got.append((shard, int.from_bytes(f.read(8), "little")))
                except FileNotFoundError:  # a shard without n-grams; train() compares the sum
                    pass
            yield pa.RecordBatch.from_pydict({"shard": pa.array([x for x, _ in got], pa.int64()), "n": pa.array([x for _, x in got], pa.int64())})

    return run


def train(texts: DataFrame, uri: str, order: int = 2) -> Arrays:
    """Counts the column text and writes the model below uri; only sums and one short row for each shard reach the driver."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = lambda per: max(0, (-(-size // per) - 1).bit_length())
    m = Arrays(uri, order, bits(WORD_SHARD), bits(PAIR_SHARD))
    shards = lambda n: spark.range(0, 1 << m.space(n).shard, 1, min(1 << m.space(n).shard, 1 << 16))
    with tidy(spark):
        for n in range(1, order):
            space, grams = m.space(n), _words_of(m) if n == 1 else _grams_of(m, n)
            made = _dealt(texts.mapInArrow(_count(grams, space, n == 1), _BLOCK), space).groupBy("shard").applyInArrow(_write_grams(m, n, space), "shard long, n long, tokens long").collect()
            _number(m, n, {r.shard: r.n for r in made}, PAIRS_PER_CONTEXT if n == 1 else GRAMS_PER_CONTEXT)
            m.tokens = m.tokens or sum(r.tokens for r in made)
        space = m.space(order)
        sums = _dealt(texts.mapInArrow(_count(_grams_of(m, order), space, True), _BLOCK), space).groupBy("shard").applyInArrow(_write_highest(m), _SUMS)
        for n in range(order, 1, -1):
            spans = _spans(m, n - 1)
            for span, then in zip(spans, spans[1:]):
                sums = sums.repartition(max(1, min(1 << 16, m.many(n - 1) // span + 1)), "range").sortWithinPartitions("range").mapInArrow(_deal_sums(span, then), _SUMS)
            tallies = (*_TALLY, "a1", "a2", "a3", "a4", "a3p")
            got = sums.groupBy("range").applyInArrow(_write_contexts(m, n - 1), ", ".join(f"{c} long" for c in tallies)).collect()
            k = {c: sum(r[c] for r in got) for c in tallies}
            m.discounts.insert(0, discounts([k[f"n{i}"] for i in (1, 2, 3, 4)]))
            if n == order:
                _number(m, n, {r.shard: r.n for r in shards(n).mapInArrow(_sizes_of(m), "shard long, n long").collect()}, 1)
            if m.many(n) != k["grams"]:
                raise FileNotFoundError(f"the folder has {m.many(n)} {n}-grams of {k['grams']}")
            if n > 2:
                sums = shards(n - 1).mapInArrow(_read_grams(m, n - 1), _SUMS)
    m.pairs = k["grams"]
    d = discounts([k[f"a{i}"] for i in (1, 2, 3, 4)])
    m.discounts.insert(0, d)
    m.left = (d[0] * k["a1"] + d[1] * k["a2"] + d[2] * k["a3p"]) / m.pairs if m.pairs else 1.0
    Store(uri).write("model.json", [json.dumps(asdict(m)).encode()])
    return m


def score(m: Arrays, texts: pa.Array) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    size = len(texts)
    at, h = _token_hashes(texts)
    numbers, count = _numbered(m, at, h, m.order - 1)
    starts, known = _starts(at), numbers[0] >= 0
    less = lambda n, x: np.maximum(0, x - np.array([0.0, *m.discounts[n - 1]])[np.minimum(x, 3)])
    here = _context(m, 1, numbers[0])
    p = np.where(known, less(1, here[4]), 0) / max(1, m.pairs) + m.left / (m.vocabulary + 1)
    for n in range(2, m.order + 1):
        # of the n-gram that ends a token earlier, or of the beginning
        below = np.concatenate([np.zeros((5, 1), np.int64), here[:, :-1]], axis=1)
        below[:, starts] = _context(m, n - 1, np.array([m.many(n - 1)]))
        if n < m.order:
            here = _context(m, n, numbers[n - 1])
        seen = here[4] if n < m.order else _look_up(m, n, _before(numbers[n - 2], starts, m.many(n - 1)), numbers[n - 2])[1]
        d, (total, ones, twos, more, _) = m.discounts[n - 1], below
        taken = d[0] * ones + d[1] * twos + d[2] * more
        p = np.where(total > 0, (less(n, seen) + taken * p) / np.maximum(1, total), p)
    base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
    add = lambda x: np.bincount(at, x, size)
    return {"n_tokens": np.bincount(at, minlength=size), "n_known": np.bincount(at[known], minlength=size), "base_score": add(base), "score": add(np.log10(p))}


def _scored(m: Arrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            s = score(m, texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array(np.full(len(texts), m.tokens), pa.int64()), pa.array(s["base_score"]), pa.array(s["score"]), pa.array(10 ** (-s["score"] / s["n_tokens"]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return run


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, false)"


def op1_kneser_ney(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    m = train(t.where("not held_out").select("text"), folder(docs.sparkSession, "kneser-ney"), order)
    return t.mapInArrow(_scored(m), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
