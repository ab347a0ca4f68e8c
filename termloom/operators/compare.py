"""Comparison of two releases of concept records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Discriminators in the order that results have.
CHANGES = ("added", "inactivated", "preferred_term_changed", "hierarchy_changed")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each change: change, id, preferred_term, hierarchy, old and new values.

    A concept that is active in both may have two; one that was inactive and is
    active again has none. One full join, whatever the kinds of change. Of
    records that share an id the last counts: by a column ord, if there is one,
    else by effective_time (if there is one) and then by all that is compared.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        by = [c for c in ("ord", "effective_time") if c in df.columns][:1]
        one = F.struct("preferred_term", "hierarchy", "active")
        return df.groupBy("id").agg(F.max_by(one, F.struct(*by, "active", "preferred_term", "hierarchy")).alias(name))

    j = side(old, "o").join(side(new, "n"), "id", "full")
    was, now = F.coalesce(F.col("o.active"), F.lit(False)), F.coalesce(F.col("n.active"), F.lit(False))
    none = F.lit(None).cast("string")

    def change(kind: str, cond, term, hierarchy, old_v, new_v):
        return F.when(cond, F.struct(F.lit(kind).alias("change"), term.alias("preferred_term"), hierarchy.alias("hierarchy"), old_v.alias("old_value"), new_v.alias("new_value")))

    pt_o, pt_n, h_o, h_n = F.col("o.preferred_term"), F.col("n.preferred_term"), F.col("o.hierarchy"), F.col("n.hierarchy")
    found = F.array(
        change("added", F.col("o").isNull() & now, pt_n, h_n, none, none),
        change("inactivated", was & ~now, pt_o, h_o, none, none),
        change("preferred_term_changed", was & now & (pt_o != pt_n), pt_n, h_n, pt_o, pt_n),
        change("hierarchy_changed", was & now & (h_o != h_n), pt_n, h_n, h_o, h_n),
    )
    return j.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("c.change", "id", "c.preferred_term", "c.hierarchy", "c.old_value", "c.new_value")


def ordered(changes: DataFrame) -> DataFrame:
    place = F.create_map(*[F.lit(x) for i, c in enumerate(CHANGES) for x in (c, i)])[F.col("change")]
    return changes.orderBy(place, "id")


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def report(old: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """(line_no, line): the counts and the first changes of each kind by id, as text."""
    names = {"added": "Added", "inactivated": "Inactivated", "preferred_term_changed": "Terms changed", "hierarchy_changed": "Hierarchies changed"}
    changes = compare(old, new)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(CHANGES) for x in (c, i)])[F.col("change")]
    head = F.create_map(*[F.lit(x) for c in CHANGES for x in (c, names[c])])[F.col("change")]
    kinds = old.sparkSession.createDataFrame([(c,) for c in CHANGES], "change string").join(counts(changes), "change", "left")
    titles = kinds.select((place * 1_000_000).cast("long").alias("line_no"), F.concat(head, F.lit(": "), F.coalesce("n", F.lit(0)).cast("string")).alias("line"))
    first = changes.withColumn("n", F.row_number().over(Window.partitionBy("change").orderBy("id"))).where(F.col("n") <= most)
    text = F.concat(F.lit("  "), "id", F.lit(" "), "preferred_term", F.when(F.col("old_value").isNotNull(), F.concat(F.lit(" ("), "old_value", F.lit(" -> "), "new_value", F.lit(")"))).otherwise(F.lit("")))
    return titles.unionAll(first.select((place * 1_000_000 + F.col("n")).cast("long").alias("line_no"), text.alias("line"))).orderBy("line_no")


def summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, n): active concepts on each side and changes of each kind."""
    active = lambda df, k: df.agg(F.count_if("active").alias("n")).select(F.lit(k).alias("name"), "n")
    return active(old, "active_old").unionAll(active(new, "active_new")).unionAll(counts(compare(old, new)).select(F.col("change").alias("name"), "n"))
