"""WARC archives, and the normaliser of monolithic gzip streams.

An archive is often one gzip stream over all its records, so that no record
can be read by itself. The normaliser inflates such a stream once, in pieces,
finds each record by its headers, writes it again as a gzip member of its own
and notes where: the sidecar index lists offset, length, record id and type.

archive() writes a table's pages as such monolithic files, dealt to shards by a
hash of their ids and digests, normalises each, and keeps the members and the index.
Of records with equal payloads of at least LEAST bytes the one with the
smallest id is a response and the others revisit it; a revisit keeps the
response's headers (and thereby the payload's length) but not its payload.

Digests are computed by Spark; only (digest, id) rows are grouped, aggregated
before the shuffle, and only repeated digests meet in the join, so a page that
a third of all rows repeat costs thin rows that can be split. The decisions
travel to the shards beside the pages and sort in front of them, so that the
payloads are shuffled once.

Edge cases: null html is an empty payload; rows that repeat both id and
payload are all responses if they hold the smallest id; a null id ranks last
and is written as such; a very long page is one record, in memory at once;
extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Store, cut, folder
from .textstats import slices

LEAST, ROWS_PER_SHARD, LEVEL, PIECE = 100, 4096, 3, 1 << 16
_HEADERS_END = b"\r\n\r\n"


def record(kind: str, page: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: int | None) -> bytes:
    """One WARC/1.1 record. Ids follow from the page's id, so that a task that runs again writes the same bytes."""
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}").urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Page-ID: {'' if page is None else page}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers)}>", f"WARC-Refers-To-Page: {refers}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _HEADERS_END + block + _HEADERS_END


def headers(data: bytes) -> dict[str, str]:
    """Header fields of a record or an HTTP message, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n")[1:])}


class Inflater:
    """The bytes of a gzip file of one or many members, read in pieces of bounded size."""

    def __init__(self, source: BinaryIO, piece: int = PIECE):
        self.source, self.piece, self.held, self.z, self.rest, self.open = source, piece, bytearray(), zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        data = self.rest or self.source.read(self.piece)
        self.rest = b""
        if not data:
            if self.open:
                raise EOFError("the gzip stream ends within a member")
            return False
        out = self.z.decompress(data, self.piece)
        self.open = True
        self.held += out
        if self.z.eof:
            self.rest, self.z, self.open = self.z.unused_data, zlib.decompressobj(31), False
        else:
            self.rest = self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with the mark; None at a clean end."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("bytes after the last record")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise EOFError("the stream ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(source: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a gzip file, whatever its members."""
    stream = Inflater(source)
    while (head := stream.until(_HEADERS_END)) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        block = stream.take(int(headers(head)["content-length"]))
        stream.take(len(_HEADERS_END))
        yield head, block


def normalise(source: BinaryIO, note: Callable[[dict], None], level: int = LEVEL) -> Iterator[bytes]:
    """The members that a gzip file's records make, one each; note gets every record's index entry."""
    at = 0
    for head, block in records(source):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(head) + z.compress(block) + z.compress(_HEADERS_END) + z.flush()
        h = headers(head)
        note({"offset": at, "length": len(member), "id": h.get("warc-record-id"), "type": h.get("warc-type")})
        at += len(member)
        yield member


def _writer(uri: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, name, n = Store(uri), f"part-{TaskContext.get().partitionId():07d}", 0

        def whole() -> Iterator[bytes]:
            nonlocal n
            z, said = zlib.compressobj(1, zlib.DEFLATED, 31), (None, None, None)
            for rows, texts in slices(batches, "html"):
                cols = (rows.column(i).to_pylist() for i in range(6))
                for page, digest, decides, refers, size, url, html in zip(*cols, texts):
                    if decides:
                        said = (page, digest, refers)
                        continue
                    n += 1
                    refers = said[2] if said[:2] == (page, digest) else None
                    kind = "response" if refers is None else "revisit"
                    yield z.compress(record(kind, page, url, digest, size, html.as_py().encode() if refers is None else b"", refers))
            yield z.flush()

        store.write(f"{name}.mono.gz", whole())
        if n:
            index: list[dict] = []
            with store.stream(f"{name}.mono.gz") as f:
                store.write(f"{name}.warc.gz", normalise(f, index.append, level))
            store.write(f"{name}.cdxj", ["".join(json.dumps(x) + "\n" for x in index).encode()])
            yield pa.RecordBatch.from_pydict({"shard": [name], "records": pa.array([n], pa.int64())})
        store.delete(f"{name}.mono.gz")

    return run


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to): the pages whose payload an earlier page has."""
    thin = pages.select("page_id", F.sha2(F.col("html"), 256).alias("digest")).where(F.octet_length("html") >= least)
    # cut off, so that the join has a plain shuffle on either side and a hot digest's rows can be split
    first = cut(thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to"))
    return thin.join(first, "digest").where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def archive(pages: DataFrame, uri: str, least: int = LEAST, rows_per_shard: int = ROWS_PER_SHARD, level: int = LEVEL) -> DataFrame:
    """Writes the archives below uri: NAME.warc.gz and its index NAME.cdxj; returns (shard, records)."""
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shards = -(-pages.count() // rows_per_shard) or 1
    full = t.select("page_id", F.sha2(F.col("html"), 256).alias("digest"), F.lit(False).alias("decides"), F.lit(None).cast("long").alias("refers_to"), F.octet_length("html").cast("long").alias("size"), "url", "html")
    none = [F.lit(None).cast(x).alias(y) for x, y in (("long", "size"), ("string", "url"), ("string", "html"))]
    said = decisions(t, least).select("page_id", "digest", F.lit(True).alias("decides"), "refers_to", *none)
    dealt = full.unionAll(said).repartition(shards, "page_id", "digest").sortWithinPartitions(F.col("page_id").asc_nulls_last(), "digest", F.col("decides").desc())
    return cut(dealt.mapInArrow(_writer(uri, level), "shard string, records long"))


def read_member(store: Store, name: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the one record that the index places at offset."""
    with store.open(f"{name}.warc.gz") as f:
        f.seek(offset)
        return _parsed(f.read(length))


def _parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    z = zlib.decompressobj(31)
    data = z.decompress(member)
    if not z.eof or z.unused_data:
        raise ValueError("an index entry is not one whole member")
    at = data.index(_HEADERS_END) + 4
    h = headers(data[:at])
    return h, data[at : at + int(h["content-length"])]


def _reader(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store = Store(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                cols: tuple[list, ...] = ([], [], [], [], [])
                with store.open(f"{name}.cdxj") as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with store.open(f"{name}.warc.gz") as f:
                    for x in index:
                        f.seek(x["offset"])
                        h, block = _parsed(f.read(x["length"]))
                        http, _, payload = block.partition(_HEADERS_END)
                        size, digest, kind = int(headers(http)["content-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                        page, refers = h["warc-page-id"], h.get("warc-refers-to-page")
                        for c, v in zip(cols, (int(page) if page else None, size, digest, kind, int(refers) if refers else None)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read(shards: DataFrame, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read by the index and verified."""
    return shards.select("shard").repartition(max(1, shards.count()), "shard").mapInArrow(_reader(uri), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(pages: DataFrame) -> DataFrame:
    """Writes every page as a WARC record and returns what the archives hold."""
    uri = folder(pages.sparkSession, "warc")
    return read(archive(pages, uri), uri)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
