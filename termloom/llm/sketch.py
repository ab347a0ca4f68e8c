"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of SHINGLE lower-cased words (fewer words: the
whole sequence; none: no shingle). A shingle's hash is the 64-bit hash of its
words' hashes. The sketch is the k least distinct hashes, ascending. Sketches
merge by union and cutting back to k, so a text's parts, or many documents,
can be sketched apart. From two sketches come estimates of resemblance,
containment and, from one, of the number of distinct shingles.

Edge cases: null text is empty; an empty sketch resembles an empty one fully
and no other at all; repeated rows give equal sketches. Rows of one id follow
one another by the hash of their texts, then by text. A very long text is one
row, whose hashes are sorted in memory; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

K, SHINGLE = 256, 5
WHITE = r"[\x20\x09-\x0D]+"
_SPAN = 2.0**64


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the k least distinct shingle hashes of a text."""
    bare = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\f\r"))

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(n >= shingle, runs).otherwise(F.array(F.xxhash64(w)))

    # one-element arrays bind the trimmed text and its words, so that neither is computed again for every shingle
    words = F.transform(F.split(bare, WHITE), lambda w: F.xxhash64(w))
    hashes = F.when(bare == "", F.array().cast("array<long>")).otherwise(F.element_at(F.transform(F.array(words), of), 1))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches describe together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group, k hashes at most.

    Every hash is counted once for each group and task before the shuffle, and
    only k ranked ones of each of a group's hash buckets go on, so that no
    task gathers a group's hashes whole.
    """
    each = sketches.select(*by, F.explode(column).alias("__h")).distinct().withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(64)))
    some = each.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h"))).where(F.col("__r") <= k)
    top = some.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two texts' shingle sets, 0 to 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(both))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(float(k)) - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that are in the second."""
    j, x, y = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (x + y) / x))


def as_text(a: Column) -> Column:
    """Sixteen hex digits for each hash, in the sketch's order."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


ROWS_PER_BUCKET, INTERVALS, HEADS = 1024, 256, 1_000_000
_TOP = (1 << 63) - 1


def _intervals(d: DataFrame, rows_per_bucket: int) -> list[tuple[int, int, int]]:
    """(start, width, hot) of at most 2 * INTERVALS ranges of the column d, each cut evenly into buckets of width.

    Starts are quantiles, so their number doesn't grow with the table. A value
    that two quantiles hit is a hot range of its own, cut by hash.
    """
    shares = [k / INTERVALS for k in range(1, INTERVALS)]
    got = d.agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.percentile_approx("d", shares, 10_000).alias("q")).first()
    if not got.n:
        return [(0, 1, 0)]
    many = -(-got.n // (rows_per_bucket * INTERVALS))
    hits = Counter(got.q)
    starts = {got.low: 0} | {x: n if n > 1 else 0 for x, n in hits.items()}
    for x, n in hits.items():
        if n > 1 and x < _TOP:
            starts.setdefault(x + 1, 0)
    out = []
    for x, then in zip(at := sorted(starts), [*at[1:], got.high + 1]):
        size = 1 << 63 if starts[x] else (then >> 1) - (x >> 1) + 1
        out.append((x, min(_TOP, max(1, -(-size // (many * max(1, starts[x]))))), int(starts[x] > 0)))
    return out


def _bucket(d: Column, h: Column, intervals: list[tuple[int, int, int]]) -> Column:
    """Ascending numbers of buckets of rows in the order of (d, h); the interval by binary search in a literal array."""
    start, width, hot = (F.array(*[F.lit(x[k]).cast("long") for x in intervals]) for k in range(3))
    steps = [1 << k for k in reversed(range(len(intervals).bit_length()))]
    upto = F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(start, at + step - 1) <= d, F.lit(False)), at + step).otherwise(at))

    def number(i: Column) -> Column:
        along = F.when(F.get(hot, i) == 1, h).otherwise(F.shiftright(d, 1) - F.shiftright(F.get(start, i), 1))
        return F.shiftleft(i.cast("long"), 32) + F.floor(along / F.get(width, i)).cast("long")

    return F.element_at(F.transform(F.array(F.greatest(upto - 1, F.lit(0))), number), 1)


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, heads: int = HEADS) -> DataFrame:
    """(doc_id, text, h, bucket, ghost): every document in a bucket of ids, and the first one of each bucket once more as a ghost in the bucket before.

    Within a bucket, ordered by ghost, descending doc_id, h (the text's hash)
    and text, each document is followed by the next one of the whole table
    (after the last: the first), so a window over a bucket sees every
    neighbour while the texts are shuffled once. A null id comes last. The
    buckets follow from a fixed number of quantiles of the ids; rows that share
    an id are spread by h. A few numbers reach the driver. The firsts, a thin
    row for each bucket, are broadcast if they are heads at most and joined by
    a shuffle otherwise.
    """
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # 62 bits of the hash; rows without an id come behind those of the least one, whose place they share
    h = F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(id_.isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    t = docs.select(id_.alias("doc_id"), text.alias("text"), h.alias("h"))
    d = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63))))  # falls where the id rises
    places = _intervals(t.select(d.alias("d")), rows_per_bucket)
    t = t.withColumn("d", d).withColumn("bucket", _bucket(F.col("d"), F.col("h"), places))
    first = t.select("bucket", "d", "h").groupBy("bucket").agg(F.min(F.struct("d", "h")).alias("k"))
    first = cut(first.select("bucket", "k.d", "k.h"))
    around = Window.orderBy("bucket")  # a row for each bucket
    last = F.max("bucket").over(Window.partitionBy(F.lit(0)))
    to = first.select(F.col("d").alias("d1"), F.col("h").alias("h1"), F.coalesce(F.lag("bucket").over(around), last).alias("to"))
    to = F.broadcast(to) if first.count() <= heads else to
    ghosts = t.join(to, (F.col("d") == F.col("d1")) & (F.col("h") == F.col("h1"))).groupBy("to").agg(F.min(F.struct("text", "doc_id", "h")).alias("x"))
    return t.select("doc_id", "text", "h", "bucket", F.lit(False).alias("ghost")).unionAll(ghosts.select("x.doc_id", "x.text", "x.h", F.col("to").alias("bucket"), F.lit(True).alias("ghost")))


def op8_sketch(docs: DataFrame, k: int = K, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses; also resemblance's kin for the next text."""
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    pair = with_next(docs, rows_per_bucket).withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 3) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    both = pair.select("doc_id", "text", "h", "bucket", "ghost", "n_chars", F.when(~F.col("ghost"), edited).alias("edited"), sketch(F.col("text"), k).alias("s"))
    then = both.withColumn("s_next", F.lead("s").over(order)).where("not ghost").withColumn("e", sketch(F.col("edited"), k))
    return then.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("s_next"), k).alias("near_next"),
        containment(F.col("s"), F.col("e"), k).alias("in_edited"), distinct(F.col("s"), k).alias("n_shingles"),
    )
