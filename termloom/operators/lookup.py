"""Point, bulk and filter queries over concept records, maps, refsets and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(limit: int | None, most: int | None) -> int | None:
    """The rows to return: limit up to most; none given, or a negative one, is unlimited."""
    if limit is None or limit < 0:
        return None
    return limit if most is None else min(limit, most)


def top(df: DataFrame, order: list[Column | str], limit: int | None, most: int | None = None, offset: int = 0) -> DataFrame:
    """Ordered, then cut to a page."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    n = capped(limit, most)
    return out if n is None else out.limit(n)


def by_id(concepts: DataFrame, id_: str) -> DataFrame:
    return concepts.where(F.col("id") == id_)


def by_ids(concepts: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of many ids (column id) by one semi-join."""
    return concepts.join(ids.select("id").distinct(), "id", "left_semi")


def by_code(concepts: DataFrame, maps: DataFrame, code: str) -> DataFrame:
    """A code of digits (or none) is an id; any other is looked up backwards in the ctv3 map."""
    if code == "" or (code.isascii() and code.isdigit()):
        return by_id(concepts, code)
    return concepts.join(maps.where((F.col("terminology") == "ctv3") & (F.col("code") == code)).select(F.col("concept_id").alias("id")), "id", "left_semi")


def active_term(concepts: DataFrame, id_: str) -> DataFrame:
    return by_id(concepts, id_).where("active").select("preferred_term")


def term_and_activity(concepts: DataFrame, id_: str) -> DataFrame:
    return by_id(concepts, id_).select("preferred_term", "active")


def place(concepts: DataFrame, id_: str) -> DataFrame:
    return by_id(concepts, id_).select("hierarchy", "children_count")


def in_hierarchy(concepts: DataFrame, hierarchy: str, limit: int | None = 100, most: int | None = 1000) -> DataFrame:
    return top(concepts.where(F.col("hierarchy") == hierarchy).select("id", "preferred_term", "fsn"), ["preferred_term", "id"], limit, most)


def term_like(concepts: DataFrame, pattern: str) -> DataFrame:
    """Records whose term matches a pattern whatever its case."""
    return concepts.where(F.col("preferred_term").ilike(pattern))


def with_attribute(concepts: DataFrame, attribute: str) -> DataFrame:
    return concepts.where(F.col("attributes")[attribute].isNotNull())


def changed_at(concepts: DataFrame, effective_time: str) -> DataFrame:
    return concepts.where(F.col("effective_time") == effective_time)


def leaves(concepts: DataFrame) -> DataFrame:
    return concepts.where("children_count = 0")


def parents_of(concepts: DataFrame, id_: str) -> DataFrame:
    """Parents from the record itself, in its order."""
    return by_id(concepts, id_).select(F.explode("parents").alias("p")).select("p.id", "p.fsn")


def with_synonyms(concepts: DataFrame, shorter_than: int) -> DataFrame:
    """(id, synonym): synonyms of records that have any, under so many characters."""
    return concepts.where("size(synonyms) > 0").select("id", F.explode("synonyms").alias("synonym")).where(F.length("synonym") < shorter_than)


def map_forward(maps: DataFrame, concept: str, terminology: str) -> DataFrame:
    _known(terminology)
    return maps.where((F.col("concept_id") == concept) & (F.col("terminology") == terminology)).select("code").orderBy("code")


def map_reverse(concepts: DataFrame, maps: DataFrame, code: str, terminology: str) -> DataFrame:
    _known(terminology)
    hit = maps.where((F.col("code") == code) & (F.col("terminology") == terminology)).select(F.col("concept_id").alias("id"))
    return concepts.join(hit, "id").select("id", "preferred_term", "fsn", "hierarchy").orderBy("id")


def first_only(maps: DataFrame) -> DataFrame:
    """One concept for each code of a terminology: the one with the least id."""
    return maps.groupBy("code", "terminology").agg(F.min("concept_id").alias("concept_id"))


def _known(terminology: str) -> None:
    if terminology not in ("ctv3", "read2"):
        raise ValueError(f"unknown terminology {terminology!r}")


UNKNOWN = "(unknown refset)"


def refsets(concepts: DataFrame, members: DataFrame, limit: int | None = 200, most: int | None = 5000) -> DataFrame:
    """(id, preferred_term, n_members) of every refset with members, unknown ones first as they have no term."""
    n = members.groupBy(F.col("refset_id").alias("id")).agg(F.count("*").alias("n_members"))
    named = n.join(concepts.select("id", F.col("preferred_term").alias("t")), "id", "left")
    return top(named, [F.col("t").asc_nulls_first(), F.col("id")], limit, most).select("id", F.coalesce("t", F.lit(UNKNOWN)).alias("preferred_term"), "n_members")


def refset_info(concepts: DataFrame, members: DataFrame, refset: str) -> DataFrame:
    """The refset's own record with its member count, 0 if it has none."""
    n = members.where(F.col("refset_id") == refset).groupBy(F.col("refset_id").alias("id")).agg(F.count("*").alias("n_members"))
    return by_id(concepts, refset).join(n, "id", "left").select("id", "preferred_term", "fsn", "module", "effective_time", F.coalesce("n_members", F.lit(0)).alias("n_members"))


def refset_members(concepts: DataFrame, members: DataFrame, refset: str, limit: int | None = 200, most: int | None = 5000) -> DataFrame:
    ids = members.where(F.col("refset_id") == refset).select(F.col("referenced_component_id").alias("id"))
    return top(concepts.join(ids, "id").select("id", "preferred_term", "hierarchy"), ["preferred_term", "id"], limit, most)


def memberships(concepts: DataFrame, members: DataFrame, id_: str) -> DataFrame:
    """The refsets that a concept is in, by term."""
    mine = members.where(F.col("referenced_component_id") == id_).select(F.col("refset_id").alias("id")).distinct()
    return mine.join(concepts.select("id", F.col("preferred_term").alias("t")), "id", "left").orderBy(F.col("t").asc_nulls_first(), "id").select("id", F.coalesce("t", F.lit(UNKNOWN)).alias("preferred_term"))


def full_record(concepts: DataFrame, members: DataFrame, id_: str) -> DataFrame:
    """A record with its refsets in member_of."""
    mine = memberships(concepts, members, id_).agg(F.array_sort(F.collect_list(F.struct("preferred_term", "id"))).alias("member_of"))
    return by_id(concepts, id_).crossJoin(F.broadcast(mine))  # one row


# --- profiles -----------------------------------------------------------------


def hierarchy_breakdown(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("hierarchy").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "hierarchy")


def totals(concepts: DataFrame) -> DataFrame:
    return concepts.agg(F.count("*").alias("total"), F.count_if(~F.col("active")).alias("inactive"), F.max("schema_version").alias("schema_version"))


def hierarchies(concepts: DataFrame) -> DataFrame:
    return concepts.select("hierarchy").where("hierarchy is not null and hierarchy <> ''").distinct().orderBy("hierarchy")


def release_timeline(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("effective_time").agg(F.count("*").alias("n")).orderBy("effective_time")


def length_histogram(concepts: DataFrame, column: str) -> DataFrame:
    return concepts.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n")).orderBy("length")


def depth_profile(concepts: DataFrame) -> DataFrame:
    depth = F.size("hierarchy_path")
    return concepts.groupBy("hierarchy").agg(F.round(F.avg(depth), 1).alias("avg_depth"), F.max(depth).alias("max_depth"), F.count("*").alias("n"))


def shares(concepts: DataFrame) -> DataFrame:
    """Each hierarchy's share of all concepts in percent."""
    n = concepts.groupBy("hierarchy").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def top_in_each(concepts: DataFrame, by: str, value: str, n: int = 2) -> DataFrame:
    """Rows that rank() up to n by value within by."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc())
    return concepts.withColumn("rnk", F.rank().over(w)).where(F.col("rnk") <= n)


def most_refsets(members: DataFrame, limit: int = 10) -> DataFrame:
    n = members.groupBy(F.col("referenced_component_id").alias("id")).agg(F.countDistinct("refset_id").alias("n_refsets"))
    return top(n, [F.col("n_refsets").desc(), "id"], limit)


def longest(concepts: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return top(concepts.select("id", "preferred_term", F.size(column).alias("n")), [F.col("n").desc(), "id"], limit)
