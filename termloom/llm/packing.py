"""Packing token sequences by first-fit decreasing over a tournament tree.

Every document's ids are cut into full pieces of CAPACITY and a rest. A full
piece is a sequence by itself. Rests go to randomised groups (by a hash of id
and place), about PER_GROUP in each however many documents there are, and each
group is packed by itself: longest first, into the leftmost open sequence with
room for it, which a tournament tree over the room of all sequences finds in
logarithmic time. Then room of more than SLACK of the capacity is filled: the
emptiest sequences are taken apart and their pieces cut to fit. What is left
of the last one is cut to lengths that are powers of two, which need no
padding.

The product is whole sequences with their ids and the pieces they are made
of; where each piece lies, and its checksum, are read off the sequences.

A group's rows hold at most CAPACITY ids each, so a group is bounded by
PER_GROUP times that. Full pieces go to groups of their own, as many as the
bytes of text ask for, so that long documents don't make groups larger. Rows
alike in id and text are numbered within a task and spread by that number, so
they don't meet in one group.

Edge cases: null and empty texts consist of the end id; a very long text is
encoded part by part and cut into many pieces; repeated rows are packed each; a null id is kept; other columns are ignored; an empty table
packs to nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .textstats import slices

CAPACITY, PER_GROUP, SLACK, END = 4096, 4096, 1 / 64, 2


class Tournament:
    """Room of each bin in a complete binary tree whose inner nodes hold the most room below."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes size from the leftmost bin that has as much room, and returns the bin."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.leaves
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The indexes in each bin; ties of size in the order given."""
    tree, bins = Tournament(max(1, len(sizes)), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(sizes: list[int], capacity: int = CAPACITY, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (index, start, length): parts of the items, each part of an item once."""
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    fill = lambda b: sum(x[2] for x in b)
    bins.sort(key=fill, reverse=True)  # stable
    free, low, last = [capacity - fill(b) for b in bins], 0, len(bins) - 1
    while low < last and free[low] <= slack * capacity:
        low += 1
    while low < last:
        i, start, n = bins[last].pop()
        take = min(n, free[low])
        bins[low].append((i, start, take))
        free[low] -= take
        if take < n:
            bins[last].append((i, start + take, n - take))
        elif not bins[last]:
            last -= 1
        if free[low] <= slack * capacity:
            low += 1
            while low < last and free[low] <= slack * capacity:
                low += 1
    bins = bins[: last + 1]
    if bins and capacity - fill(bins[-1]) > slack * capacity:
        rest = bins.pop()
        left = fill(rest)
        while left:
            size, one = 1 << (left.bit_length() - 1), []
            while size:
                i, start, n = rest.pop()
                take = min(n, size)
                one.append((i, start, take))
                if take < n:
                    rest.append((i, start + take, n - take))
                size -= take
                left -= take
            bins.append(one)
    return bins


_PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, salt long"
_SEQUENCE = "sequence_id long, ids binary, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"


def _cutter(tokenizer: str, capacity: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        tail = b"" if end is None else end.to_bytes(enc.width, "little")
        for rows, texts in slices(batches):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for d, x in zip(rows.column(0).to_pylist(), enc.encode(texts)):
                x += tail
                n = len(x) // enc.width
                again = seen[key := hash((d, x))]
                seen[key] += 1
                for a in range(0, n, capacity):
                    part = x[a * enc.width : (a + capacity) * enc.width]
                    for c, v in zip(cols, (d, a, len(part) // enc.width, n, part, again and (task << 32) + again)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64())], ["doc_id", "start", "length", "doc_tokens", "ids", "salt"])

    return run


def _packer(width: int, capacity: int, slack: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        g = key[0].as_py()
        t = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        doc, start, size, total = (t[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens"))
        ids = t["ids"]
        rests = [i for i, n in enumerate(size) if n < capacity]
        sequences = [[(i, 0, capacity)] for i in range(len(size) - len(rests))]
        sequences += [[(rests[j], a, n) for j, a, n in parts] for parts in pack([size[i] for i in rests], capacity, slack)]
        whole, pieces = [], []
        for parts in sequences:
            whole.append(b"".join(np.frombuffer(ids[i].as_py(), f"<u{width}")[a : a + n].astype("<u4").tobytes() for i, a, n in parts))
            at, held = 0, []
            for i, a, n in parts:
                held.append({"doc_id": doc[i], "start": start[i] + a, "length": n, "doc_tokens": total[i], "offset": at})
                at += n
            pieces.append(held)
        piece = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "offset")])
        return pa.table({"sequence_id": pa.array([(g << 32) + i for i in range(len(whole))], pa.int64()), "ids": pa.array(whole, pa.binary()), "pieces": pa.array(pieces, pa.list_(piece))})

    return run


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, per_group: int = PER_GROUP, end: int | None = END, slack: float = SLACK) -> DataFrame:
    """A row for each sequence: sequence_id, ids (4 bytes each), and the pieces in it: doc_id, start, length, doc_tokens, offset."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, size = t.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups, full = -(-rows // per_group) or 1, -(-(size or 0) // (per_group * capacity)) or 1
    by = F.xxhash64("doc_id", "start", "ids", "salt")
    g = F.when(F.col("length") < capacity, F.pmod(by, F.lit(groups))).otherwise(groups + F.pmod(by, F.lit(full)))
    cut = t.mapInArrow(_cutter(tokenizer, capacity, end), _PIECE).withColumn("g", g).drop("salt")
    return cut.groupBy("g").applyInArrow(_packer(encoder(tokenizer).width, capacity, slack), _SEQUENCE)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, per_group: int = PER_GROUP, end: int | None = END, slack: float = SLACK, tokens: bool = False) -> DataFrame:
    """A row for each piece of sequences(): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; its ids, 4 bytes each, if tokens."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if tokens else [])]

    def piece(p):
        own = F.substring(F.col("ids"), (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))
        of = [p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(own).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), F.col("sequence_id").alias("sequence_id"), p["offset"].alias("offset")]
        return F.struct(*of, *([own.alias("ids")] if tokens else []))

    whole = sequences(docs, tokenizer, capacity, per_group, end, slack)
    return whole.select(F.explode(F.transform("pieces", piece)).alias("p")).select(*[F.col("p").getField(c).alias(c) for c in names])


def op6_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences, with the checksum of its ids there."""
    return packed(docs, tokenizer)
