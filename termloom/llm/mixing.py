"""Mixing sources to target weights by blocks, in DataFrame functions only.

The words of each source, its documents in a fixed order, form a stream that
is cut into blocks of BLOCK words. The mix is a sequence of slots, dealt to
output shards of SLOTS each. Every slot of a shard draws its source with
probability target / total, so a shard's source counts are a multinomial
draw. A source's slots are numbered over all shards; where the draws exceed
the source's quota of blocks, the last of them go to the sources that were
drawn too rarely, so totals meet the quotas. A source's slot number j reads
block permutation(j mod blocks) of pass j div blocks, another pseudorandom
permutation of the source's block indexes for each pass, and joins it by index.

Everything is drawn from hashes of fixed seeds, so reruns agree whatever the
partitioning. Hot sources are dealt by document hash into chunks, whose sums
give every document its place in the stream without gathering a source.
Only tables of a row for each source or cell go through the driver, and only
where there are HEADS sources at most; all other joins shuffle both sides.

Targets: sources ordered by code point, null last, weigh 1, 2, 3, repeating;
they share the words of all documents; a target stops at MOST times its
source's words, and the excess is shared anew by weight until none is above.

Edge cases: null and empty texts have size 0 and are never taken; a very long
text spans many blocks, a row each; columns of any name pass through; sources
without words get target 0; documents that repeat an id are told apart by
source and text, and rows alike in all three are dealt one after another; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_row, cut, running, shuffled

BLOCK, SLOTS, MOST, SEED = 256, 1024, 3, 20
SLOTS_PER_TASK = 16_384
ROWS_PER_CHUNK = 512  # small, so that a chunk of a source with a third of all rows is no larger than its neighbours
CELLS = 4096  # of the cumulated shares, by which a draw finds its source
HEADS = 4096  # so many sources at most are broadcast, a row for each and a row for each cell


def words(text: Column) -> Column:
    """The number of words of a text."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Water filling in closed form: a source is full if the level at which all
    the rest share what is left reaches MOST times its size over its weight,
    so with the sources in the order of that ratio a running sum decides.
    Numbering and running sums go by one task over a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    run = every.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(every), F.sum("weight").over(every)
    left = total - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (heavy - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # in this order the sources below the level come first; the first that is not fixes the level
    # of all after it (for those the level, figured as if it had been full, is lower still)
    a = w.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.lit(most) * F.col("source_size"))
    b = a.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    t = F.when(F.col("full") | F.col("final").isNull(), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("final") * F.col("weight"))
    return b.select("source", "source_size", "weight", t.alias("target"))


_FEW, _WALKS = 6, 96  # a walk ends outside with a chance under 2^-96; most end after a few steps


def _image(y: str) -> str:
    """SQL of one bijection of 0 .. mask, from the columns mask, half and key; all products stay under 2^63."""
    for k in range(3):
        odd, add = f"((shiftrightunsigned(key, {k * 20}) & 1048575) | 1)", f"shiftrightunsigned(key, {7 + 11 * k})"
        y = f"(((({y}) * {odd}) & mask) ^ ({add} & mask))"
        y = f"({y} ^ shiftright({y}, half))"
    return y


def permuted(slots: DataFrame, out: str = "block") -> DataFrame:
    """Adds column out: the image of x under a pseudorandom permutation of 0 .. n - 1 for each seed (columns x, n, seed).

    Rounds of odd multiplication and shifted xor permute the numbers below the
    least power of two not under n; an image outside is mapped on until it
    falls inside, each time with a chance of a half at least.
    """
    bits = F.length(F.bin(F.col("n") - 1))
    wide = slots.withColumn("key", F.xxhash64("seed", F.lit(SEED))).withColumn("mask", F.expr("shiftleft(1L, length(bin(n - 1))) - 1")).withColumn("half", F.greatest(F.lit(1), (bits / 2).cast("int")))
    step = lambda y, n: f"aggregate(sequence(1, {n}), {y}, (y, i) -> case when y < n then y else {_image('y')} end)"
    walk = f"transform(array({step(_image('x'), _FEW)}), z -> case when z < n then z else {step('z', _WALKS - _FEW)} end)[0]"
    return wide.withColumn(out, F.expr(walk)).drop("key", "mask", "half")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every document; h tells rows apart by id, source and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
        _hash().alias("h"),
    )


def _hash() -> Column:
    return F.xxhash64("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")))


def _by_source(df: DataFrame, sources: int) -> DataFrame:
    """A join's side with a row for each of so many sources, or some for each; one source may have a third of the other side's rows."""
    return F.broadcast(df) if sources <= HEADS else shuffled(df)


def placed(rows: DataFrame, block: int = BLOCK, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents with their source's number and their start in its stream, sources with blocks and quota)."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(per, most).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * blocks), F.floor(F.lit(most) * blocks))).otherwise(0).cast("long")
    sources = cut(t.withColumn("n", blocks).withColumn("quota", quota))
    chunks = -(-rows.count() // ROWS_PER_CHUNK) or 1
    named = _by_source(sources.select(F.col("source").alias("s2"), "sid"), sources.count())
    d = rows.join(named, F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "sid", "size", "h", F.pmod("h", F.lit(chunks)).alias("chunk"))
    sums = d.groupBy("sid", "chunk").agg(F.sum("size").alias("s"))
    offset = running(sums, ["sid"], "chunk", "s", "before").drop("s")
    inside = Window.partitionBy("sid", "chunk").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return d.join(shuffled(offset), ["sid", "chunk"]).withColumn("start", start).select("doc_id", "sid", "size", "h", "start"), sources


def plan(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(shard, slot, sid, pass, block): which block each slot of the mix reads."""
    spark = sources.sparkSession
    some = sources.where("quota > 0").select("sid", "n", "quota")
    k = some.agg(F.sum("quota").alias("total"), F.count("*").alias("sources")).first()
    total = k.total or 0
    width = max(1, -(-total // max(CELLS, k.sources)))
    high = F.sum("quota").over(Window.orderBy("sid"))
    cells = some.withColumn("hi", high).withColumn("lo", F.col("hi") - F.col("quota")).withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})"))).select("cell", "lo", "hi", "sid")
    draws = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {slots}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, total))).alias("r"))
    # cut off in steps, as the driver's plans of it all would take hundreds of MB
    drawn = cut(draws.withColumn("cell", F.expr(f"r div {width}")).join(_by_source(cells, k.sources), "cell").where("lo <= r and r < hi").select("shard", "slot", "sid"))
    per = drawn.groupBy("sid", "shard").agg(F.count("*").alias("c"))
    # slots beyond a quota, numbered through, take the places of the sources that fell short
    tally = some.join(shuffled(per.groupBy("sid").agg(F.sum("c").alias("c"))), "sid", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    flow = tally.withColumn("over", F.greatest(F.lit(0), F.col("c") - F.col("quota"))).withColumn("under", F.greatest(F.lit(0), F.col("quota") - F.col("c")))
    upto = lambda c: F.sum(c).over(Window.orderBy("sid")) - F.col(c)
    flow = cut(flow.select("sid", "n", "quota", "c", "over", "under", upto("over").alias("over_at"), upto("under").alias("under_at")))
    # what a slot needs of its source comes with its shard's row, so that no source's slots meet in one task
    before = running(per, ["sid"], "shard", "c", "before").drop("c").join(_by_source(flow.select("sid", "n", "quota", "over_at"), k.sources), "sid")
    j = F.col("before") + F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    known = drawn.join(shuffled(before), ["sid", "shard"]).withColumn("j", j)
    stay = known.where("j < quota").select("shard", "slot", "sid", "n", "j")
    moved = known.where("j >= quota").select("shard", "slot", (F.col("over_at") + F.col("j") - F.col("quota")).alias("rank"))
    places = flow.where("under > 0").select("sid", "n", F.explode(F.expr("sequence(c, quota - 1)")).alias("j"), "c", "under_at").select("sid", "n", "j", (F.col("under_at") + F.col("j") - F.col("c")).alias("rank"))
    full = stay.unionAll(moved.join(shuffled(places), "rank").select("shard", "slot", "sid", "n", "j"))
    spread = full.repartition(-(-total // SLOTS_PER_TASK) or 1, "slot")  # walking costs more than the rows' few bytes tell
    reads = spread.withColumn("pass", F.expr("j div n")).withColumn("x", F.expr("j % n")).withColumn("seed", F.xxhash64("sid", "pass"))
    return cut(permuted(reads).select("shard", "slot", "sid", "pass", "block"))


def pieces(docs: DataFrame, sources: DataFrame, mix: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sid, size, h, start, first, words, uses): the part of each document in each block, and how often the mix reads it."""
    uses = mix.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    part = docs.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    a, z = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return part.join(shuffled(uses), ["sid", "block"], "left").select("doc_id", "sid", "size", "h", "start", (a - F.col("start")).alias("first"), (z - a).alias("words"), F.coalesce("uses", F.lit(0)).alias("uses"))


def sharded(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(shard, slot, sid, pass, block, text): the mix itself, the words of the block that each slot reads.

    A block's text is put together once, from the parts of the documents in
    it, and joins the slots by index; a block holds so many words at most.
    """
    d, sources = placed(cut(sized(docs)), block)
    d = cut(d)
    mix = plan(sources, slots)
    part = pieces(d, sources, mix, block).withColumn("block", F.expr(f"(start + first) div {block}")).select("doc_id", "h", "sid", "block", "start", "first", "words")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("h"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w"))
    one = each.groupBy("h").agg(F.first("w").alias("w"))  # rows alike in id, source and text
    texts = part.join(shuffled(one), "h").select("sid", "block", (F.col("start") + F.col("first")).alias("at"), F.array_join(F.slice("w", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("t"))
    blocks = texts.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("p")).select("sid", "block", F.array_join("p.t", " ").alias("text"))
    return mix.join(shuffled(blocks), ["sid", "block"]).select("shard", "slot", "sid", "pass", "block", "text")


def op7_mixing(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes, for every document."""
    d, sources = placed(cut(sized(docs)), block)
    d = cut(d)
    taken = pieces(d, sources, plan(sources), block).groupBy("doc_id", "sid", "size", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    every = taken.unionByName(d.where("size = 0").select("doc_id", "sid", "size", "start", F.lit(0).cast("long").alias("taken")))
    return every.join(_by_source(sources.select("sid", "source_size", "target"), sources.count()), "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of docs: a document comes once for each time that any of it is read.

    Its m-th row has the words of the blocks that are read m times or more, in
    order, with the white space before them (the text itself, if that is all
    of it); n_chars is counted anew where there is such a column.
    """
    rows = cut(sized(docs))
    d, sources = placed(rows, block)
    d = cut(d)
    reads = pieces(d, sources, plan(sources), block).groupBy("doc_id", "h", "sid", "start", "size").agg(F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("parts"), F.max("uses").alias("most"))
    reads = reads.where("most > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "parts", "most")
    cols = docs.columns
    keyed = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), _hash().alias("h"))
    one = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("h", "id").orderBy("h"))).where("rn = 1")  # equal rows have one text
    both = one.join(shuffled(reads), (one["h"] == reads["__h"]) & one["id"].eqNullSafe(reads["__id"]))
    each = both.select("row", "parts", F.explode(F.expr("sequence(1L, most)")).alias("m"))
    split = F.expr(r"regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    kept = F.expr("filter(parts, p -> p.uses >= m)")
    text = F.when(F.size(kept) == F.size("parts"), F.col("row.text")).otherwise(
        F.element_at(F.transform(F.array(split), lambda w: F.array_join(F.flatten(F.transform(kept, lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")), 1)
    )
    out = each.select("row", text.alias("t"))
    swap = {"text": F.col("t"), "n_chars": F.length("t").cast(docs.schema["n_chars"].dataType) if "n_chars" in cols else None}
    return out.select(*[(swap[c] if c in swap else F.col("row").getField(c)).alias(c) for c in cols])
