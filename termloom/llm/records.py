"""Token ids as length-delimited binary records with an offset index.

Documents in ascending doc_id order (null first, ties by the text's hash) are
dealt to shards by range, so that the rows of one id may lie in several. A shard is two files: NAME.rec holds, for each document, the
payload's length (8 bytes), the masked CRC-32C of those 8 bytes (4), the
payload, and the masked CRC-32C of the payload (4), all little-endian; NAME.idx
holds the number of records, then every record's offset, then every record's
number of ids, as 8-byte integers, for reads in any order. A payload is the
doc_id (8 bytes), whether there is one (1), the bytes of an id (1), the ids.

A file appears under its name only when it is whole, and its contents follow
from the rows alone, so a task that runs twice does no harm. The manifest, a
table with a row for each shard, says how many documents and ids precede it.

Edge cases: null text is empty and has the end id only; repeated rows are
records of their own; a very long text is encoded part by part and is one
record; other columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crc import masked_of
from .encoding import encoder
from .shared import Store, cut, folder
from .textstats import slices

ROWS_PER_SHARD = 8192
_HEAD, _HEAD_SIZE = "<q??", 10


def frame(payloads: list[bytes]) -> list[bytes]:
    """The framed record of each payload."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    of_size, of_data = masked_of(sizes), masked_of(payloads)
    return [b"".join((s, struct.pack("<I", a), p, struct.pack("<I", b))) for s, a, p, b in zip(sizes, of_size.tolist(), payloads, of_data.tolist())]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at the offsets; raises ValueError where a checksum doesn't hold."""
    heads = [data[o : o + 8] for o in offsets]
    sizes = [struct.unpack("<Q", h)[0] for h in heads]
    found = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, sizes)]
    said = [(struct.unpack_from("<I", data, o + 8)[0], struct.unpack_from("<I", data, o + 12 + n)[0]) for o, n in zip(offsets, sizes)]
    for i, (a, b) in enumerate(zip(masked_of(heads).tolist(), masked_of(found).tolist())):
        if said[i] != (a, b):
            raise ValueError(f"a record's checksum doesn't hold at offset {offsets[i]}")
    return found


def _writer(uri: str, tokenizer: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, enc, offsets, counts = f"part-{TaskContext.get().partitionId():07d}", encoder(tokenizer), [], []
        tail = b"" if end is None else end.to_bytes(enc.width, "little")
        at = 0

        def chunks() -> Iterator[bytes]:
            nonlocal at
            for rows, texts in slices(batches, "text"):
                ids = [x + tail for x in enc.encode(texts)]
                heads = [struct.pack(_HEAD, 0 if d is None else d, d is not None, enc.width == 4) for d in rows.column(0).to_pylist()]
                for r, x in zip(frame([h + x for h, x in zip(heads, ids)]), ids):
                    offsets.append(at)
                    counts.append(len(x) // enc.width)
                    at += len(r)
                    yield r

        store, stream = Store(uri), chunks()
        first = next(stream, None)
        if first is None:
            return
        import itertools

        n = store.write(f"{name}.rec", itertools.chain([first], stream))
        store.write(f"{name}.idx", [np.array([len(offsets), *offsets, *counts], "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [name], "docs": pa.array([len(offsets)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64()), "bytes": pa.array([n], pa.int64())})

    return run


def write(docs: DataFrame, uri: str, tokenizer: str, end: int | None = 0, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Writes the shards below uri; returns the manifest (shard, docs, tokens, bytes, docs_before, tokens_before)."""
    text = F.col("text").cast("string")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    shards = -(-docs.count() // rows_per_shard) or 1
    dealt = t.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    made = cut(dealt.mapInArrow(_writer(uri, tokenizer, end), "shard string, docs long, tokens long, bytes long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return made.withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0))).withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shard(uri: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a shard, in order, a few megabytes at a time."""
    store = Store(uri)
    with store.open(f"{name}.idx") as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    offsets = index[1 : n + 1]
    with store.open(f"{name}.rec") as f:
        ends = np.append(offsets[1:], f.size())
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, offsets[i] + (4 << 20), side="right")))
            f.seek(int(offsets[i]))
            data = f.read(int(ends[j - 1] - offsets[i]))
            for p in unframe(data, (offsets[i:j] - offsets[i]).tolist()):
                d, known, wide = struct.unpack_from(_HEAD, p)
                yield d if known else None, np.frombuffer(p, "<u4" if wide else "<u2", offset=_HEAD_SIZE)
            i = j


def read_one(uri: str, name: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard, found by the index alone."""
    store = Store(uri)
    with store.open(f"{name}.idx") as f:
        f.seek(8 * (1 + k))
        at = int(np.frombuffer(f.read(8), "<i8")[0])
    with store.open(f"{name}.rec") as f:
        f.seek(at)
        n = struct.unpack("<Q", f.read(8))[0]
        f.seek(at)
        (p,) = unframe(f.read(n + 16), [0])
    d, known, wide = struct.unpack_from(_HEAD, p)
    return d if known else None, np.frombuffer(p, "<u4" if wide else "<u2", offset=_HEAD_SIZE)


def _reader(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for d, ids in read_shard(uri, name):
                    for x, v in zip(rows, (d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        x.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def digests(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files; a task for each shard."""
    return manifest.select("shard", "tokens_before").repartition(max(1, manifest.count()), "shard").mapInArrow(_reader(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents as records and returns what the files hold."""
    uri = folder(docs.sparkSession, "records")
    return digests(docs.sparkSession, write(docs, uri, tokenizer), uri)
