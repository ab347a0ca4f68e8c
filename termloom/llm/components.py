"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shuffled


def _least(e: DataFrame, by: str, other: str) -> DataFrame:
    return e.groupBy(by).agg(F.min(other).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that node reaches; edges has columns u and v.

    Nodes without an edge to another node are absent. Each round is two joins
    on thin rows (a hub's rows can be split, as the joins are plain shuffled
    ones) and ends in the shared folder, so lineage stays short and nothing
    but one count a round reaches the driver. Rounds grow with the logarithm
    of the nodes. Self-links, repeated links and an empty table are fine.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _least(large, "u", "v")
        e = cut(
            large.join(shuffled(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now.n, now.h)
