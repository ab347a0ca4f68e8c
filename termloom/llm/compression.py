"""Quality rules by compression bands.

Zstandard ratios (bytes of text to bytes compressed) of a whole text and of
its fixed chunks reject repetitive text (ratio above a band) and text that
does not compress (below it). Ratios rise with the length whatever a text
says. A text's excess is the logarithm of its ratio less that of EXPECTED, a
rough curve for prose; each class of length (STEPS to a doubling of the bytes)
has limits of its own to it: FENCE times the distance of the quartiles beyond
either quartile, over all distinct texts of the corpus in that class and those
within half a doubling, or further off while these are fewer than LEAST.
Quartiles stay where they are while less than a quarter of these texts is junk,
and copies count once, so a text that a third of all rows repeat moves nothing. The fixed BANDS (bytes
from, lowest, highest) hold besides, for small corpora.

A text is rejected if its whole ratio is outside its limits, or if over
CHUNK_SHARE of its chunks are outside the chunks' limits, got alike from all
chunks of all distinct texts. Repetition that a whole ratio hides in a long text
thus still counts. The rest after the full chunks is judged as the text's last
CHUNK bytes, so every byte of a text of a chunk or more is in some chunk; of a
shorter one the whole is the chunk, and its class holds.

Scale. Texts are read once; a thin row for each is kept in the shared folder.
The corpus comes down to a histogram of classes and of ratios 1/BINS of a
doubling apart, whose size doesn't depend on the number of rows.

Edge cases: null and empty texts have ratio 0, no words and no verdict of
their own (kept by the bands; the base rule on word counts fails them). A very
long text is compressed in one go, its chunks one by one. Repeated rows are
judged alike, each on its own; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textstats import counts, packed_sizes, slices

LEVEL, CHUNK, CHUNK_SHARE = 3, 4096, 0.2
STEPS, BINS, FENCE, LEAST, NARROW = 4, 256, 2.5, 200, 0.04  # NARROW: the least distance of quartiles, in doublings
#: Bytes, and how prose of that length compresses, roughly.
EXPECTED = ((8, 0.47), (16, 0.64), (32, 0.78), (64, 0.9), (128, 1.2), (256, 1.5), (512, 1.7), (1024, 1.88), (2048, 2.04), (4096, 2.16), (8192, 2.25), (16384, 2.35), (65536, 2.5))
#: Bytes from, lowest and highest ratio of a whole text, whatever the corpus.
BANDS = ((0, 0.0, 3.0), (128, 0.8, 3.0), (256, 1.05, 3.2), (512, 1.2, 3.4), (1024, 1.4, 3.6), (4096, 1.5, 4.0), (16384, 1.6, 4.5))
CHUNK_BAND = (1.5, 3.8)
MIN_WORDS, REPEAT_PERCENT = 10, 20
CHUNKS = -1  # the class of chunks

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, base_failed boolean, n_bytes long, class int, ratio double, excess double, chunks array<double>"


def measures(texts: pa.Array, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes, class, whole ratio, excess, ratios of the chunks) of each text; an empty one has class 0, ratio 0 and excess 0."""
    whole, parts, size = packed_sizes(texts, LEVEL, chunk)
    long, ratio = np.log2(np.maximum(1, size)), size / np.maximum(1, whole)
    expected = np.interp(long, *(np.log2([x[k] for x in EXPECTED]) for k in (0, 1)))
    return size, np.floor(STEPS * long).astype(np.int32), ratio, np.where(size > 0, np.log2(np.maximum(ratio, 1e-9)) - expected, 0.0), [chunk / p for p in parts]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        c = counts(texts)
        size, of, ratio, excess, parts = measures(texts)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), *(pa.array(c[k], pa.int64()) for k in _COUNTS), pa.array(failed), pa.array(size, pa.int64()), pa.array(of), pa.array(ratio), pa.array(excess), pa.array(parts, pa.list_(pa.float64())), rows.column(2)],
            ["doc_id", *_COUNTS, "base_failed", "n_bytes", "class", "ratio", "excess", "chunks", "h"],
        )


def limits(histogram: Iterable[tuple[int, int, int]], least: int = LEAST, fence: float = FENCE) -> dict[int, tuple[float, float]]:
    """(lowest, highest) excess of each class, from (class, bin, how many); of CHUNKS the logarithm of a chunk's ratio."""
    held: dict[int, dict[int, int]] = {}
    for of, b, n in histogram:
        held.setdefault(of, {})[b] = held.get(of, {}).get(b, 0) + n
    out = {}
    for of in held:
        span, own = 0, dict(held[of])
        around = [] if of == CHUNKS else sorted((abs(x - of), x) for x in held if x not in (of, CHUNKS))
        while around and (sum(own.values()) < least or around[0][0] <= STEPS // 2):
            span = around[0][0]
            while around and around[0][0] == span:
                for b, n in held[around.pop(0)[1]].items():
                    own[b] = own.get(b, 0) + n
        bins = np.array(sorted(own))
        upto = np.cumsum([own[b] for b in bins.tolist()])
        q1, q3 = ((bins[np.searchsorted(upto, share * upto[-1])] + 0.5) / BINS for share in (0.25, 0.75))
        reach = fence * max(NARROW, q3 - q1)
        out[of] = float(q1 - reach), float(q3 + reach)
    return out


def histogram(measured: DataFrame) -> DataFrame:
    """(class, bin, n) over the distinct texts (column h) and their chunks."""
    one = measured.where("n_bytes > 0").groupBy("h", "class", "excess").agg(F.max("chunks").alias("chunks"))  # alike for equal texts
    each = one.select(F.explode(F.concat(F.array(F.struct("class", "excess")), F.transform("chunks", lambda x: F.struct(F.lit(CHUNKS).alias("class"), F.log2(x).alias("excess"))))).alias("x"))
    return each.select("x.class", F.floor(F.col("x.excess") * BINS).cast("int").alias("bin")).groupBy("class", "bin").agg(F.count("*").alias("n"))


def judged(measured: DataFrame, found: dict[int, tuple[float, float]], bands=BANDS, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """measured with chunks_out, the share of chunks outside, and kept: within the limits and not failed by the base rule."""
    spark = measured.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in found.items()], "class int, low double, high double")  # a row for each class of length
    low, high = (2.0**x for x in found.get(CHUNKS, (-64.0, 64.0)))
    low, high = max(low, chunk_band[0]), min(high, chunk_band[1])
    out = F.when(F.size("chunks") > 0, F.size(F.filter("chunks", lambda x: (x < low) | (x > high))) / F.size("chunks")).otherwise(0.0)
    fixed = F.lit(True)
    for start, a, z in bands:
        fixed = F.when(F.col("n_bytes") >= start, F.col("ratio").between(a, z)).otherwise(fixed)
    within = (F.col("n_bytes") == 0) | (F.col("excess").between(F.col("low"), F.col("high")) & fixed)
    both = measured.join(F.broadcast(table), "class", "left").withColumn("chunks_out", out)
    return both.withColumn("kept", ~F.col("base_failed") & within & (F.col("chunks_out") <= chunk_share))


def op10_compression(docs: DataFrame) -> DataFrame:
    """Word counts, the base rule, the verdict, the whole ratio, its excess and the limits to that, and the share of chunks outside, for every document."""
    text = F.col("text").cast("string")
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(_measure, f"{_MEASURED}, h long"))
    found = limits((r["class"], r["bin"], r["n"]) for r in histogram(measured).collect())
    return judged(measured, found).select("doc_id", *_COUNTS, "base_failed", "kept", "ratio", "excess", F.col("low").alias("excess_from"), F.col("high").alias("excess_to"), "chunks_out")
