"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that
differ in at most two bits, one segment differs in at most one, so both yield
the same one-wildcard variant of it: (segment, wildcard bit, the other 31
bits). Each distinct fingerprint is indexed under its 64 variants; equal
variants meet in an equality join and each pair is verified by its bit count.

A variant shared by more than CROWD fingerprints (a run of near copies) is not
expanded into pairs. Its fingerprints go by an exact way instead: two
fingerprints differ in at most two bits exactly if their one-bit
neighbourhoods meet, so each is indexed under itself and its 64 neighbours and
linked to the least one found there. At most 65 fingerprints can meet at one
such key, all within two bits of one another; no link is lost.

Definitions of edge cases: a null or empty text, or one without words, has
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle of the whole sequence; repeated rows count as copies; a row whose
doc_id is null has a fingerprint and the component of its group, which is null
only if no row of the group has an id. A very long text's shingles are hashed a
few thousand at a time. Other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import as_row, cut, shuffled

SHINGLE, SEED, BITS, SEGMENT = 3, 42, 64, 32
ROWS_PER_TASK = 16_384  # of fingerprints, each of which has 64 variants
CROWD = 32  # above it a variant's fingerprints go by the exact way of neighbourhoods


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, by numpy; bit i is set if it is set in over half the shingle hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.zeros(len(words), np.int64)
    np.cumsum(size[:-1] + 1, out=start[1:])
    stop = (start + size)[min(shingle, len(words)) - 1 :]
    ones, f = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 15):
        h = np.array([f(body[x:y], SEED) for x, y in zip(start[a : min(n, a + (1 << 15))].tolist(), stop[a : min(n, a + (1 << 15))].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): one row for each document; fp holds the 64 bits as a signed long, h is xxhash64 of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all that differ in at most two bits."""
    half = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x")), F.struct(F.lit(1).alias("s"), F.expr("shiftrightunsigned(fp, 32)").alias("x")))).alias("h")
    # the key holds segment, wildcard and the other 31 bits: 1 + 5 + 32 bits, exact
    variants = (
        distinct.select("fp", half)
        .select("fp", F.col("h.s").alias("s"), F.col("h.x").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1))).alias("i"))
        .select("fp", F.expr("shiftleft(cast(s * 32 + i as bigint), 32) | (x & ~shiftleft(1L, i))").alias("k"))
    )
    # cut off, so that the join has a plain shuffle on either side and a hot variant's rows can be split
    shared = cut(variants.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(variants.join(shuffled(shared), "k"))
    few = met.where(F.col("n") <= crowd).select("k", "fp")
    pairs = few.join(shuffled(few.select("k", F.col("fp").alias("v"))), "k").where("fp < v").select(F.col("fp").alias("u"), "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    near = many.select("fp", F.explode(F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")).alias("k"))
    hub = near.groupBy("k").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(shuffled(hub), "k").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionAll(stars)


def _classes(marked: DataFrame, crowd: int) -> DataFrame:
    """(fp, root): the least fingerprint that each distinct one reaches."""
    distinct = cut(marked.select("fp").distinct())
    # as many tasks as its variants, not its few bytes, ask for
    spread = distinct.repartition(-(-distinct.count() // ROWS_PER_TASK) or 1, "fp")
    found = components(links(spread, crowd)).select(F.col("node").alias("fp"), "root")
    return distinct.join(shuffled(found), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: the least doc_id reachable over links of at most two bits."""
    marked = cut(fingerprints(docs))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = _classes(marked, crowd).join(shuffled(first), "fp")
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = classes.join(shuffled(lowest), "root").select("fp", "component_id")
    return marked.join(shuffled(of), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each group of near-duplicates, all columns: that with the least doc_id (null last), then the least hash of its text.

    Of rows alike in both, one stays, the least of all columns that can be
    ordered. Rows without an id have their group like any other.
    """
    marked = cut(fingerprints(docs))
    one = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k"))
    stay = _classes(marked, crowd).join(shuffled(one), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.none", F.coalesce("k.doc_id", F.lit(0)).alias("id"), "k.h").distinct()
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(as_row(docs).alias("row"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rank = [F.col("row").getField(f.name) for f in docs.schema.fields if f.dataType.typeName() in _ORDERED]
    of = Window.partitionBy("none", "id", "h").orderBy(*rank)
    kept = keyed.join(shuffled(stay), ["none", "id", "h"], "left_semi").withColumn("n", F.row_number().over(of)).where("n = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


_ORDERED = {"string", "long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz", "binary"} | {"decimal"}


def op2_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
