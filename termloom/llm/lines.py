"""Substring dedup by hashed lines, paragraphs and sentences.

A text is cut into units: lines (or paragraphs, cut at blank lines), and the
sentences of each, so that a passage set into the middle of other text is found
too. One of fewer than MIN_WORDS words goes together with its neighbours, so
that passages in short lines are found. A unit is normalised (white space
collapsed, lower case) and hashed to 128 bits. Digests are grouped over the
whole corpus; the occurrence that ranks earliest by (doc_id, text hash,
start) stays and all others are removed, but for those that overlap it, as in
a short line said over and over. Spans are code-point offsets into the
original text, half open; a unit takes the white space that follows it along.

Only digests and offsets are shuffled for the grouping, pre-aggregated before
the shuffle, so a line that a third of all documents share costs one row a
task; the join back is a plain shuffled one whose hot keys can be split.

Edge cases: null and empty texts have no units and pass unchanged; rows that
repeat both id and text are one occurrence and stay alike; a null id ranks
first; a very long text is one row, its units are found one by one; documents
that lose all their text stay, with an empty text; extra columns pass through,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_row, cut

MIN_WORDS = 5
_ROWS = 1 << 16
_OUTER = {"line": re.compile(r"[^\n]*\n+|[^\n]+"), "paragraph": re.compile(r"(?s).+?(?:\n[ \t]*)+\n|.+")}
_SENTENCE = re.compile(r"[^.!?]*[.!?]+[^\s.!?]*\s*|[^.!?]+")


def _joined(parts: list[tuple[int, int, list[str]]], i: int, min_words: int) -> tuple[int, int, list[str]]:
    """(first, last, words) of a part and, while it is short, of those that follow it or, at the end, that precede it."""
    j, k, run = i, i, parts[i][2]
    while len(run) < min_words and k + 1 < len(parts):
        k += 1
        run = run + parts[k][2]
    while len(run) < min_words and j:
        j -= 1
        run = parts[j][2] + run
    return j, k, run


def units(text: str, by: str = "line", min_words: int = MIN_WORDS, sentences: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit of a text that has words enough, a short one together with its neighbours."""
    outer = [(m.start(), m.end(), m.group().lower().split()) for m in _OUTER[by].finditer(text)]
    for i, (start, end, words) in enumerate(outer):
        if len(words) < min_words:
            j, k, run = _joined(outer, i, min_words)
            if words and len(run) >= min_words:
                yield outer[j][0], outer[k][1], xxhash.xxh3_128_digest(" ".join(run))
            continue
        yield start, end, xxhash.xxh3_128_digest(" ".join(words))
        if not sentences:
            continue
        inner = [(x.start(), x.end(), x.group().lower().split()) for x in _SENTENCE.finditer(text, start, end)]
        for n in range(len(inner)):
            j, k, run = _joined(inner, n, min_words)
            if k - j + 1 < len(inner):
                yield inner[j][0], inner[k][1], xxhash.xxh3_128_digest(" ".join(run))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the spans, which may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _unit_rows(by: str, min_words: int, sentences: bool):
    names = ["k1", "k2", "id", "h", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hs, starts, ends, digests = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            k = pa.Array.from_buffers(pa.int64(), 2 * len(ids), [None, pa.py_buffer(b"".join(digests))]).to_numpy().reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names)
            for x in (ids, hs, starts, ends, digests):
                x.clear()
            return out

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for a, z, d in units(t.as_py() or "", by, min_words, sentences):
                    ids.append(i)
                    hs.append(h)
                    starts.append(a)
                    ends.append(z)
                    digests.append(d)
                    if len(ids) >= _ROWS:
                        yield flush()
        if ids:
            yield flush()

    return run


def removed_spans(docs: DataFrame, by: str = "line", min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """(id, h, spans): what is removed of each document that loses anything; h is xxhash64 of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_unit_rows(by, min_words, sentences), "k1 long, k2 long, id long, h long, start long, end long")
    rank = F.struct("id", "h", "start", "end")
    # cut off, so that the join has a plain shuffle on either side and a hot digest's rows can be split
    dup = cut(found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("k1", "k2", "first"))
    overlaps = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("start") < F.col("first.end"))
    later = found.join(dup, ["k1", "k2"]).where(~overlaps)
    return later.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def deduplicate(docs: DataFrame, by: str = "line", min_words: int = MIN_WORDS, sentences: bool = True, spans: str | None = None) -> DataFrame:
    """docs with the later occurrences cut from text (and n_chars, if there is one, counted anew).

    spans names an added column with the merged spans that were removed; it
    takes the place of a column that has the name.
    """
    lost = removed_spans(docs, by, min_words, sentences)
    fields = [f for f in docs.schema.fields if f.name != spans]
    names = [f.name for f in fields]
    at, had = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    span_t = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    whole = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    both = whole.join(lost, whole["id"].eqNullSafe(lost["id"]) & (whole["h"] == lost["h"]), "left")
    # by place, as a column of docs may have any name
    flat = both.select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(names)], F.col("spans"))
    schema = T.StructType([*fields, *([T.StructField(spans, span_t)] if spans else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, gone = list(b.columns), [[(x["start"], x["end"]) for x in s or ()] for s in b.column(b.num_columns - 1).to_pylist()]
            texts = [without(t.as_py(), g) if g and t.is_valid else t.as_py() for t, g in zip(b.column(at), gone)]
            cols[at] = pa.array(texts, b.column(at).type)
            if had is not None:
                sizes = [len(t) if g else n for t, g, n in zip(texts, gone, cols[had].to_pylist())]
                cols[had] = pa.array(sizes, cols[had].type)
            cols[-1:] = [pa.array([[{"start": x, "end": y} for x, y in _merged(g)] for g in gone], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] if spans else []
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return flat.mapInArrow(run, schema)


def op4_lines(docs: DataFrame) -> DataFrame:
    """doc_id, the text that stays, the merged spans removed, and how many code points they hold, for every document."""
    kept = deduplicate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spans="removed")
    return kept.select("doc_id", "text", "removed", F.expr("aggregate(removed, 0L, (a, s) -> a + s.end - s.start)").alias("removed_chars"))
