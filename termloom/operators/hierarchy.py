"""Traversal, closure and comparison over a polyhierarchy of (child_id, parent_id) edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut as _cut


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def distinct_edges(isa: DataFrame) -> DataFrame:
    return isa.select("child_id", "parent_id").where("child_id <> parent_id").distinct()


def closure(isa: DataFrame, concepts: DataFrame | None = None, include_self: bool = False, most: int = 10_000) -> DataFrame:
    """(ancestor_id, descendant_id, depth): every pair once, with the least number of steps.

    Semi-naive: each round extends only the pairs found in the round before
    and drops those already known, so a cycle ends and no path is walked
    twice. Rounds are as many as the hierarchy is deep; each writes its own
    pairs to the checkpoint folder, once, and the result is all rounds'.
    Descendants are limited to concepts at the end; ancestors needn't be
    among them.
    """
    edges = _cut(distinct_edges(isa))
    up = edges.select(F.col("child_id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    rounds = [edges.select(F.col("parent_id").alias("ancestor_id"), F.col("child_id").alias("descendant_id"), F.lit(1).alias("depth"))]
    for depth in range(2, most):
        step = rounds[-1].join(up, "ancestor_id").select(F.col("above").alias("ancestor_id"), "descendant_id").where("ancestor_id <> descendant_id").distinct()
        known = _together(rounds).select("ancestor_id", "descendant_id")
        found = _cut(step.join(known, ["ancestor_id", "descendant_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            break
        rounds.append(found)
    total = _together(rounds)
    if concepts is not None:
        total = total.join(concepts.select(F.col("id").alias("descendant_id")).distinct(), "descendant_id", "left_semi").select("ancestor_id", "descendant_id", "depth")
    if include_self:
        ids = (concepts.select("id") if concepts is not None else edges.select(F.explode(F.array("child_id", "parent_id")).alias("id"))).distinct()
        total = total.unionAll(ids.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth")))
    return total


def reachable(isa: DataFrame, seeds: DataFrame, down: bool, most: int = 10_000) -> DataFrame:
    """(seed, id, depth): what each seed (column id) reaches strictly, down or up, with the least number of steps."""
    edges = distinct_edges(isa)
    a, b = ("parent_id", "child_id") if down else ("child_id", "parent_id")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct()
    rounds: list[DataFrame] = []
    for depth in range(1, most):
        new = frontier.join(step, "id").select("seed", F.col("next").alias("id")).where("seed <> id").distinct()
        if rounds:
            new = new.join(_together(rounds).select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = _cut(new)
        if frontier.isEmpty():
            break
        rounds.append(frontier.withColumn("depth", F.lit(depth)))
    return _together(rounds) if rounds else frontier.withColumn("depth", F.lit(0)).limit(0)


def children(concepts: DataFrame, isa: DataFrame, of: str, limit: int | None = 50, most: int = 500) -> DataFrame:
    """Direct children by term, each once."""
    c = concepts.join(isa.where(F.col("parent_id") == of).select(F.col("child_id").alias("id")).distinct(), "id")
    return _ordered(c, limit, most)


def parents(concepts: DataFrame, isa: DataFrame, of: str) -> DataFrame:
    """Direct parents by term, each once."""
    return _ordered(concepts.join(isa.where(F.col("child_id") == of).select(F.col("parent_id").alias("id")).distinct(), "id"), None, 0)


def _ordered(df: DataFrame, limit: int | None, most: int) -> DataFrame:
    out = df.select("id", "preferred_term", "hierarchy").orderBy("preferred_term", "id")
    return out if limit is None or limit < 0 else out.limit(min(limit, most))


def _reached(isa: DataFrame, of: str, down: bool, closed: DataFrame | None) -> DataFrame:
    """(id, depth): what one concept reaches strictly, read off a closure if there is one."""
    if closed is None:
        seeds = isa.sparkSession.createDataFrame([(of,)], "id string")
        return reachable(isa, seeds, down).select("id", "depth")
    a, b = ("ancestor_id", "descendant_id") if down else ("descendant_id", "ancestor_id")
    return closed.where((F.col(a) == of) & (F.col("depth") > 0)).select(F.col(b).alias("id"), "depth")


def ancestors(concepts: DataFrame, isa: DataFrame, of: str, closed: DataFrame | None = None) -> DataFrame:
    """All strict ancestors that are concepts, the one with the longest path first."""
    up = _reached(isa, of, False, closed).select("id")
    return concepts.join(up, "id").select("id", "preferred_term", "hierarchy", F.size("hierarchy_path").alias("level")).orderBy(F.col("level").desc(), "id")


def chain(concepts: DataFrame, isa: DataFrame, of: str, closed: DataFrame | None = None) -> DataFrame:
    """(depth, id, preferred_term): the ancestors that are concepts with the least number of steps to each, the nearest first."""
    return concepts.join(_reached(isa, of, False, closed), "id").select("depth", "id", "preferred_term").orderBy("depth", "id")


def descendants(concepts: DataFrame, isa: DataFrame, of: str, closed: DataFrame | None = None) -> DataFrame:
    """All strict descendants that are active; inactive ones are passed through."""
    return concepts.where("active").join(_reached(isa, of, True, closed).select("id"), "id").select("id", "preferred_term", "hierarchy")


def subsumes(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs (a, b) with subsumed: whether a is a strict descendant of b."""
    hit = closed.where("depth > 0").select(F.col("descendant_id").alias("a"), F.col("ancestor_id").alias("b"), F.lit(True).alias("__hit")).distinct()
    return pairs.join(hit, ["a", "b"], "left").withColumn("subsumed", F.coalesce("__hit", F.lit(False))).drop("__hit")


def within(closed: DataFrame, of: str, steps: int) -> DataFrame:
    """(id, depth): descendants at most so many steps below."""
    return closed.where((F.col("ancestor_id") == of) & F.col("depth").between(1, steps)).select(F.col("descendant_id").alias("id"), "depth")


def common_ancestors(closed: DataFrame, a: str, b: str) -> DataFrame:
    """(id, steps): ancestors (or selves, if the closure has them) of both, the nearest first."""
    x = closed.where(F.col("descendant_id") == a).select(F.col("ancestor_id").alias("id"), F.col("depth").alias("d1"))
    y = closed.where(F.col("descendant_id") == b).select(F.col("ancestor_id").alias("id"), F.col("depth").alias("d2"))
    return x.join(y, "id").select("id", (F.col("d1") + F.col("d2")).alias("steps")).orderBy("steps", "id")


def below_or_self_counts(closed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n): strict descendants plus one for each id."""
    n = closed.where("depth > 0").groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n"))
    return ids.select("id").join(n, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def refined(concepts: DataFrame, closed: DataFrame, of: str, attribute: str, target: str) -> DataFrame:
    """(id): concepts at or below of, one of whose targets of an attribute is at or below target."""
    low = lambda x: closed.where((F.col("ancestor_id") == x) & (F.col("depth") > 0)).select(F.col("descendant_id").alias("id")).unionAll(concepts.sparkSession.createDataFrame([(x,)], "id string")).distinct()
    has = concepts.join(low(of), "id", "left_semi").select("id", F.explode(F.col("attributes")[attribute]["id"]).alias("target"))
    return has.join(low(target).select(F.col("id").alias("target")), "target", "left_semi").select("id").distinct()


def neighbourhood(concepts: DataFrame, isa: DataFrame, of: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, kind; edges: source, target) around one concept: itself, its parents, its first children by term."""
    label = F.coalesce(F.when(F.col("preferred_term") != "", F.col("preferred_term")), F.when(F.col("fsn") != "", F.col("fsn")), F.col("id"))
    up = isa.where(F.col("child_id") == of).select(F.col("parent_id").alias("id")).distinct()
    named = concepts.select("id", label.alias("label"))
    kids = children(concepts, isa, of, limit, limit).select("id", F.col("preferred_term").alias("label"))
    above = up.join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    focal = named.where(F.col("id") == of)
    nodes = focal.withColumn("kind", F.lit("focal")).unionAll(above.withColumn("kind", F.lit("parent"))).unionAll(kids.withColumn("kind", F.lit("child")))
    edges = above.select(F.col("id").alias("source"), F.lit(of).alias("target")).unionAll(kids.select(F.lit(of).alias("source"), F.col("id").alias("target")))
    return nodes, edges


def first_parents(isa: DataFrame) -> DataFrame:
    """(child_id, parent_id): the parent that ord lists first for each child."""
    return isa.groupBy("child_id").agg(F.min_by("parent_id", "ord").alias("parent_id"))


def first_parent_paths(ids: DataFrame, isa: DataFrame, names: DataFrame, root: str, limit: int = 20) -> DataFrame:
    """(id, hierarchy, hierarchy_path) along first parents.

    hierarchy is the label of the node just below the root, empty if the walk
    doesn't get there; hierarchy_path lists labels from the far end to the
    concept, nodes without a name left out but itself always there. One narrow
    self-join a step over a row for each concept, at most limit of them, fewer
    when all walks have ended.
    """
    from ..functions.scalars import strip_tag

    up = first_parents(isa)
    label = names.select(F.col("id").alias("node"), strip_tag(F.col("name")).alias("label"))
    # for each node with a parent: the parent and the parent's label, so a step is one join
    hop = up.select(F.col("child_id").alias("at"), F.col("parent_id").alias("next"))
    hop = hop.join(label.withColumnRenamed("node", "next").withColumnRenamed("label", "next_label"), "next", "left")
    hop = _cut(hop.select("at", "next", "next_label"))
    own = ids.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("id").alias("at"), F.coalesce("label", F.lit("")).alias("at_label"), F.array(F.coalesce("label", F.lit(""))).alias("path"), F.lit("").alias("hierarchy"))
    walk, ended = _cut(own), []
    for _ in range(limit):
        j = walk.join(hop, "at", "left")
        # each step is written once, and the walks that end with it are read off it
        step = _cut(
            j.select(
                "id", F.col("next").alias("at"), F.coalesce("next_label", F.lit("")).alias("at_label"),
                F.when(F.col("next_label").isNotNull(), F.array_prepend("path", F.col("next_label"))).otherwise(F.col("path")).alias("path"),
                F.when(F.col("next") == root, F.col("at_label")).otherwise(F.col("hierarchy")).alias("hierarchy"),
            )
        )
        over = F.col("at").isNull() | (F.col("at") == root)
        ended.append(step.where(over).select("id", "hierarchy", "path"))
        walk = step.where(~over)
        if walk.isEmpty():
            break
    ended = _together([*ended, walk.select("id", "hierarchy", "path")])
    return ended.select("id", "hierarchy", F.col("path").alias("hierarchy_path"))


def rank_by(df: DataFrame, by: str, value: str, out: str = "rank") -> DataFrame:
    """rank() of value, descending, within by."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(by).orderBy(F.col(value).desc())))
