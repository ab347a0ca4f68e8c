"""A terminology made of the test tables: geography and customers, products, orders.

concepts() and edges() are what real records and edges are elsewhere; SQL is
the same in DuckDB, as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .operators import search as S
from .plans.terminology import Terminology

CONCEPT_TAGS = ("region", "nation", "segment", "customer", "supplier", "order", "type", "brand", "part")


_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_BUILT: dict[tuple[str, str], Terminology] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's frame, made once for each application, as finding its files and schema costs more than a small query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


_INDEXES: dict[tuple[str, str], S.Index] = {}


def document_index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index over the texts of documents, written once for each application, as a built artefact is, and searched many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = S.write_index(S.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"]), shared.folder(spark, "document-index"))
    return _INDEXES[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child_id, parent_id, first): every edge once; first marks the parent whose path counts."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def e(df: DataFrame, child, parent, first: bool = True) -> DataFrame:
        return df.select(child.alias("child_id"), parent.alias("parent_id"), F.lit(first).alias("first"))

    root, part = F.lit("ROOT"), F.lit("PART")
    customer, parts = t("customer"), t("part")
    out = [
        e(t("region"), key("R", "r_regionkey"), root), e(t("nation"), key("N", "n_nationkey"), key("R", "n_regionkey")),
        e(customer, key("C", "c_custkey"), key("N", "c_nationkey")), e(customer, key("C", "c_custkey"), key("SEG:", "c_mktsegment"), False), e(customer.select("c_mktsegment").distinct(), key("SEG:", "c_mktsegment"), root),
        e(t("supplier"), key("S", "s_suppkey"), key("N", "s_nationkey")), e(t("orders"), key("O", "o_orderkey"), key("C", "o_custkey")),
        e(parts, key("P", "p_partkey"), key("TY:", "p_type")), e(parts, key("P", "p_partkey"), key("BR:", "p_brand"), False),
        e(parts.select("p_type").distinct(), key("TY:", "p_type"), part), e(parts.select("p_brand").distinct(), key("BR:", "p_brand"), part), e(spark.range(1), part, root),
    ]
    df = out[0]
    for x in out[1:]:
        df = df.unionAll(x)
    return df


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, tag, n, effective_time, names): n is the key from which activity and module follow."""
    t = lambda n: table(spark, sf_dir, n)
    none, when = F.array().cast("array<string>"), F.lit("20240101")

    def n(df: DataFrame, id_, name, tag: str, key=None, at=when, names=none) -> DataFrame:
        return df.select(id_.alias("id"), name.alias("name"), F.lit(tag).alias("tag"), (key if key is not None else F.lit(1)).cast("long").alias("n"), at.alias("effective_time"), names.alias("names"))

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = [
        n(spark.range(1), F.lit("ROOT"), F.lit("Root"), "root"), n(spark.range(1), F.lit("PART"), F.lit("Part"), "product"),
        n(t("region"), key("R", "r_regionkey"), F.col("r_name"), "region"), n(t("nation"), key("N", "n_nationkey"), F.col("n_name"), "nation"),
        n(t("customer").select("c_mktsegment").distinct(), key("SEG:", "c_mktsegment"), F.col("c_mktsegment"), "segment"),
        n(t("customer"), key("C", "c_custkey"), F.col("c_name"), "customer", F.col("c_custkey")), n(t("supplier"), key("S", "s_suppkey"), F.col("s_name"), "supplier", F.col("s_suppkey")),
        n(t("orders"), key("O", "o_orderkey"), key("Order ", "o_orderkey"), "order", F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")),
        n(t("part").select("p_type").distinct(), key("TY:", "p_type"), F.col("p_type"), "type"), n(t("part").select("p_brand").distinct(), key("BR:", "p_brand"), F.col("p_brand"), "brand"),
        n(t("part"), key("P", "p_partkey"), F.col("p_name"), "part", F.col("p_partkey"), when, F.split("p_name", " ")),
    ]
    df = out[0]
    for x in out[1:]:
        df = df.unionAll(x)
    return df


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hierarchy, hierarchy_path) along first parents: the tree is four deep, so joins by name of the few upper nodes do."""
    t = lambda n: table(spark, sf_dir, n)
    r, nat = t("region"), t("nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    root = F.lit("Root")
    p = lambda df, id_, h, *path: df.select(id_.alias("id"), h.alias("hierarchy"), F.array(*path).alias("hierarchy_path"))
    rn = nat.join(r, nat["n_regionkey"] == r["r_regionkey"])
    cust = t("customer").join(rn, F.col("c_nationkey") == F.col("n_nationkey"))
    sup = t("supplier").join(rn, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    part = F.lit("Part")
    out = [
        p(spark.range(1), F.lit("ROOT"), F.lit(""), root), p(spark.range(1), F.lit("PART"), part, root, part), p(r, key("R", "r_regionkey"), F.col("r_name"), root, F.col("r_name")),
        p(rn, key("N", "n_nationkey"), F.col("r_name"), root, F.col("r_name"), F.col("n_name")), p(cust, key("C", "c_custkey"), F.col("r_name"), root, F.col("r_name"), F.col("n_name"), F.col("c_name")),
        p(sup, key("S", "s_suppkey"), F.col("r_name"), root, F.col("r_name"), F.col("n_name"), F.col("s_name")),
        p(orders, key("O", "o_orderkey"), F.col("r_name"), root, F.col("r_name"), F.col("n_name"), F.col("c_name"), key("Order ", "o_orderkey")),
        p(t("customer").select("c_mktsegment").distinct(), key("SEG:", "c_mktsegment"), F.col("c_mktsegment"), root, F.col("c_mktsegment")),
        p(t("part").select("p_type").distinct(), key("TY:", "p_type"), part, root, part, F.col("p_type")), p(t("part").select("p_brand").distinct(), key("BR:", "p_brand"), part, root, part, F.col("p_brand")),
        p(t("part"), key("P", "p_partkey"), part, root, part, F.col("p_type"), F.col("p_name")),
    ]
    df = out[0]
    for x in out[1:]:
        df = df.unionAll(x)
    return df


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical records."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    name = n.select(F.col("id").alias("pid"), F.concat("name", F.lit(" ("), "tag", F.lit(")")).alias("pfsn"))
    up = e.join(name, e["parent_id"] == name["pid"]).groupBy(F.col("child_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("parent_id").alias("id"), F.col("pfsn").alias("fsn")))).alias("parents"))
    kids = e.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children_count"))
    line, sup = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    by = line.select("l_partkey", "l_suppkey").distinct().join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    made = by.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"), F.concat("s_name", F.lit(" (supplier)")).alias("fsn")))).alias("refs")
    )
    ref = "array<struct<id:string,fsn:string>>"
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).alias("ctv3_codes"))
    sets = members(spark, sf_dir).groupBy(F.col("referenced_component_id").alias("id")).agg(F.sort_array(F.collect_list("refset_id")).alias("refsets"))
    j = n
    for x in (paths(spark, sf_dir), up, kids, made, part, sets):
        j = j.join(x, "id", "left")
    none = F.array().cast("array<string>")
    return j.select(
        "id", F.concat("name", F.lit(" ("), "tag", F.lit(")")).alias("fsn"), F.col("name").alias("preferred_term"), F.col("names").alias("synonyms"), "hierarchy", "hierarchy_path",
        F.coalesce("parents", F.array().cast(ref)).alias("parents"), F.coalesce("children_count", F.lit(0).cast("long")).alias("children_count"), (F.col("n") % 10 != 0).alias("active"),
        F.concat(F.lit("mod"), (F.col("n") % 3).cast("string")).alias("module"), "effective_time",
        F.when(F.col("refs").isNotNull(), F.create_map(F.lit("supplied_by"), F.col("refs"))).otherwise(F.create_map().cast(f"map<string,{ref}>")).alias("attributes"),
        F.coalesce("ctv3_codes", none).alias("ctv3_codes"), none.alias("read2_codes"), F.coalesce("refsets", none).alias("refsets"), F.lit(3).alias("schema_version"),
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, terminology, concept_id): several parts share a code."""
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("code"), F.lit("ctv3").alias("terminology"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("concept_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refset_id, referenced_component_id): customers by their orders' priorities; the refsets are no concepts, one of a market segment is."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.select(F.concat(F.lit("PRI:"), "o_orderpriority").alias("refset_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("referenced_component_id")).distinct()
    return a.unionAll(c.select(F.concat(F.lit("SEG:"), "c_mktsegment"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"))))


def terminology(spark: SparkSession, sf_dir: str) -> Terminology:
    """The tables of one folder; records are built once and kept, as a built artefact is, and queried many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Terminology(concepts(spark, sf_dir).persist(), edges(spark, sf_dir).select("child_id", "parent_id").persist(), maps(spark, sf_dir), members(spark, sf_dir))
    return _BUILT[key]


SQL = """
WITH RECURSIVE isa AS (
  SELECT 'R' || r_regionkey AS child_id, 'ROOT' AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'SEG:' || c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 'SEG:' || c_mktsegment, 'ROOT' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders
  UNION ALL SELECT 'P' || p_partkey, 'TY:' || p_type FROM part
  UNION ALL SELECT 'P' || p_partkey, 'BR:' || p_brand FROM part
  UNION ALL SELECT DISTINCT 'TY:' || p_type, 'PART' FROM part
  UNION ALL SELECT DISTINCT 'BR:' || p_brand, 'PART' FROM part
  UNION ALL SELECT 'PART', 'ROOT'
), rn AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'ROOT' AS id, 'Root' AS name, 'root' AS tag, 1 AS n, '20240101' AS effective_time, CAST([] AS VARCHAR[]) AS synonyms, '' AS hierarchy, ['Root'] AS path
  UNION ALL SELECT 'PART', 'Part', 'product', 1, '20240101', [], 'Part', ['Root', 'Part']
  UNION ALL SELECT 'R' || r_regionkey, r_name, 'region', 1, '20240101', [], r_name, ['Root', r_name] FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', 1, '20240101', [], r_name, ['Root', r_name, n_name] FROM rn
  UNION ALL SELECT DISTINCT 'SEG:' || c_mktsegment, c_mktsegment, 'segment', 1, '20240101', CAST([] AS VARCHAR[]), c_mktsegment, ['Root', c_mktsegment] FROM customer
  UNION ALL SELECT 'C' || c_custkey, c_name, 'customer', c_custkey, '20240101', [], r_name, ['Root', r_name, n_name, c_name] FROM customer JOIN rn ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier', s_suppkey, '20240101', [], r_name, ['Root', r_name, n_name, s_name] FROM supplier JOIN rn ON s_nationkey = n_nationkey
  UNION ALL SELECT 'O' || o_orderkey, 'Order ' || o_orderkey, 'order', o_orderkey, strftime(o_orderdate, '%Y%m%d'), [], r_name, ['Root', r_name, n_name, c_name, 'Order ' || o_orderkey]
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN rn ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'TY:' || p_type, p_type, 'type', 1, '20240101', CAST([] AS VARCHAR[]), 'Part', ['Root', 'Part', p_type] FROM part
  UNION ALL SELECT DISTINCT 'BR:' || p_brand, p_brand, 'brand', 1, '20240101', CAST([] AS VARCHAR[]), 'Part', ['Root', 'Part', p_brand] FROM part
  UNION ALL SELECT 'P' || p_partkey, p_name, 'part', p_partkey, '20240101', string_split(p_name, ' '), 'Part', ['Root', 'Part', p_type, p_name] FROM part
), kids AS (SELECT parent_id, count(*) AS k FROM isa GROUP BY parent_id),
concepts AS (
  SELECT id, name || ' (' || tag || ')' AS fsn, name AS preferred_term, synonyms, hierarchy, path AS hierarchy_path, coalesce(k, 0) AS children_count,
         n % 10 <> 0 AS active, 'mod' || (n % 3) AS module, effective_time
  FROM nodes LEFT JOIN kids ON id = parent_id
), supplied AS (SELECT DISTINCT 'P' || l_partkey AS id, 'S' || l_suppkey AS target FROM lineitem),
maps AS (SELECT p_brand || '-' || p_size AS code, 'ctv3' AS terminology, 'P' || p_partkey AS concept_id FROM part),
members AS (
  SELECT DISTINCT 'PRI:' || o_orderpriority AS refset_id, 'C' || o_custkey AS referenced_component_id FROM orders
  UNION ALL SELECT 'SEG:' || c_mktsegment, 'C' || c_custkey FROM customer
), walk AS (
  SELECT child_id AS descendant_id, parent_id AS ancestor_id, 1 AS depth FROM isa
  UNION SELECT w.descendant_id, i.parent_id, w.depth + 1 FROM walk w JOIN isa i ON w.ancestor_id = i.child_id
), closed AS (SELECT ancestor_id, descendant_id, min(depth) AS depth FROM walk GROUP BY ALL)
"""
