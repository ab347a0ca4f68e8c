"""Release files made of the test tables: two layers, with replaced, withdrawn, repeated and quoted rows.

ROWS is SQL that Spark and DuckDB both read: a table of rows for each kind of
file, with the layer and the line that a row has. Spark writes them as files,
several for each kind; the oracles take them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, surrogate
from .schema import CTV3_MAP, FSN_TYPE, IS_A, PREFERRED, RELEASE_FILES, ROOT, SYNONYM_TYPE
from .sources.release import PREFIXES

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem")
FILES = 2  # of each kind and layer
_KEY = "lpad(CAST({} AS STRING), 9, '0')"


def _id(digit: int, column: str) -> str:
    return f"'{digit}' || {_KEY.format(column)}"


ROWS = f"""
seg AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT c_mktsegment AS name FROM @customer) s),
typ AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT p_type AS name FROM @part) s),
brand AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT p_brand AS name FROM @part) s),
node AS (
  SELECT '{ROOT}' AS id, 'Everything' AS name, 'root' AS tag, CAST(0 AS BIGINT) AS k, CAST(NULL AS STRING) AS up, CAST(NULL AS STRING) AS up2
  UNION ALL SELECT '900000001', 'Product', 'product', CAST(0 AS BIGINT), '{ROOT}', CAST(NULL AS STRING)
  UNION ALL SELECT {_id(1, "r_regionkey")}, r_name, 'region', CAST(r_regionkey AS BIGINT), '{ROOT}', CAST(NULL AS STRING) FROM @region
  UNION ALL SELECT {_id(2, "n_nationkey")}, n_name, 'nation', CAST(n_nationkey AS BIGINT), {_id(1, "n_regionkey")}, CAST(NULL AS STRING) FROM @nation
  UNION ALL SELECT {_id(3, "c_custkey")}, c_name, 'customer', c_custkey, {_id(2, "c_nationkey")}, {_id(8, "seg.k")} FROM @customer JOIN seg ON seg.name = c_mktsegment
  UNION ALL SELECT {_id(4, "s_suppkey")}, s_name, 'supplier', s_suppkey, {_id(2, "s_nationkey")}, CAST(NULL AS STRING) FROM @supplier
  UNION ALL SELECT {_id(5, "p_partkey")}, p_name, 'part', p_partkey, {_id(6, "typ.k")}, {_id(7, "brand.k")} FROM @part JOIN typ ON typ.name = p_type JOIN brand ON brand.name = p_brand
  UNION ALL SELECT {_id(6, "k")}, name, 'type', CAST(k AS BIGINT), '900000001', CAST(NULL AS STRING) FROM typ
  UNION ALL SELECT {_id(7, "k")}, name, 'brand', CAST(k AS BIGINT), '900000001', CAST(NULL AS STRING) FROM brand
  UNION ALL SELECT {_id(8, "k")}, name, 'segment', CAST(k AS BIGINT), '{ROOT}', CAST(NULL AS STRING) FROM seg
), base AS (SELECT *, row_number() OVER (ORDER BY id) * 10 AS line FROM node),
concept_rows AS (
  SELECT 1 AS layer, line, id, '20240101' AS effective_time, CASE WHEN k % 17 = 3 AND tag IN ('customer', 'part') THEN '0' ELSE '1' END AS active, 'm1' AS module_id, 's' AS definition_status_id FROM base WHERE NOT (tag = 'customer' AND k % 13 = 5)
  UNION ALL SELECT 1, line + 1, id, '20240201', '1', 'm2', 's' FROM base WHERE tag = 'part' AND k % 9 = 4
  UNION ALL SELECT 2, line, id, '20240301', CASE WHEN k % 5 = 0 THEN '0' ELSE '1' END, 'm3', 's' FROM base WHERE tag IN ('customer', 'part') AND (k % 7 = 2 OR (tag = 'customer' AND k % 13 = 5))
), description_rows AS (
  SELECT 1 AS layer, line AS line, id || '1' AS id, '20240101' AS effective_time, CASE WHEN tag = 'supplier' AND k % 23 = 9 THEN '0' ELSE '1' END AS active, 'm1' AS module_id, id AS concept_id, 'en' AS language_code, '{FSN_TYPE}' AS type_id, name || ' (' || tag || ')' AS term, 'c' AS case_significance_id FROM base
  UNION ALL SELECT 1, line - 1, id || '0', '20230101', '0', 'm1', id, 'en', '{FSN_TYPE}', 'Old ' || name || ' (' || tag || ')', 'c' FROM base WHERE tag = 'part' AND k % 10 = 7
  UNION ALL SELECT 1, line + 1, id || '2', '20240101', '1', 'm1', id, 'en', '{FSN_TYPE}', name || ' again (' || tag || ')', 'c' FROM base WHERE tag = 'part' AND k % 6 = 1
  UNION ALL SELECT 1, line + 2, id || '3', '20240101', '1', 'm1', id, 'en', '{SYNONYM_TYPE}', name, 'c' FROM base WHERE k % 4 <> 3
  UNION ALL SELECT 1, line + 3, id || '4', '20240101', '1', 'm1', id, 'fr', '{SYNONYM_TYPE}', name || ' fr', 'c' FROM base WHERE k % 3 = 0
  UNION ALL SELECT 1, line + 4, id || '5', '20240101', '1', 'm1', id, 'en-GB', '{SYNONYM_TYPE}', '"' || name || '", the "' || tag || '"', 'c' FROM base WHERE k % 5 = 1
  UNION ALL SELECT 1, line + 5, id || '6', '20240101', '1', 'm1', id, 'en', '900000000000550004', 'What ' || name || ' is', 'c' FROM base WHERE k % 8 = 1
  UNION ALL SELECT 2, line, id || '7', '20240301', '1', 'm3', id, 'en', '{SYNONYM_TYPE}', name || ' v2', 'c' FROM base WHERE k % 7 = 2
), relationship_rows AS (
  SELECT 1 AS layer, line AS line, id || '1' AS id, '20240101' AS effective_time, '1' AS active, 'm1' AS module_id, id AS source_id, up AS destination_id, '0' AS relationship_group, '{IS_A}' AS type_id, 'c' AS characteristic_type_id, 'o' AS modifier_id FROM base WHERE up IS NOT NULL
  UNION ALL SELECT 1, CASE WHEN tag = 'part' AND k % 5 = 3 THEN line - 1 ELSE line + 1 END, id || '2', '20240101', CASE WHEN k % 19 = 6 THEN '0' ELSE '1' END, 'm1', id, up2, '0', '{IS_A}', 'c', 'o' FROM base WHERE up2 IS NOT NULL AND k % 4 <> 1
  UNION ALL SELECT 2, line, id || '3', '20240301', '1', 'm3', id, up, '0', '{IS_A}', 'c', 'o' FROM base WHERE tag = 'customer' AND k % 21 = 4
  UNION ALL SELECT 1, 1000000000 + l_partkey * 100000 + l_suppkey, {_id(5, "l_partkey")} || CAST(l_suppkey AS STRING), '20240101', CASE WHEN l_suppkey % 10 = 9 THEN '0' ELSE '1' END, 'm1', {_id(5, "l_partkey")}, {_id(4, "l_suppkey")}, '1',
    CASE WHEN l_suppkey % 3 = 0 THEN '363698007' WHEN l_suppkey % 3 = 1 THEN '116676008' ELSE '900002' END, 'c', 'o' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM @lineitem) l
), language_rows AS (
  SELECT 1 AS layer, line AS line, id || 'a' AS id, '20240101' AS effective_time, '1' AS active, 'm1' AS module_id, '900' AS refset_id, id || '3' AS referenced_component_id, CASE WHEN k % 2 = 0 THEN '{PREFERRED}' ELSE '5' END AS acceptability_id FROM base WHERE k % 4 <> 3
  UNION ALL SELECT 1, line + 1, id || 'b', '20240101', '1', 'm1', '901', id || '4', '{PREFERRED}' FROM base WHERE k % 6 = 0
  UNION ALL SELECT 1, line + 2, id || 'c', '20240101', '1', 'm1', '900', id || '5', CASE WHEN k % 3 = 1 THEN '{PREFERRED}' ELSE '5' END FROM base WHERE k % 5 = 1
  UNION ALL SELECT 1, line + 3, id || 'd', '20240101', '0', 'm1', '900', id || '3', '5' FROM base WHERE k % 8 = 0
  UNION ALL SELECT 2, line, id || 'e', '20240301', '1', 'm3', '901', id || '3', '5' FROM base WHERE k % 8 = 4
  UNION ALL SELECT 2, line + 1, id || 'f', '20240301', '1', 'm3', '900', id || '7', '{PREFERRED}' FROM base WHERE k % 14 = 2
), map_rows AS (
  SELECT 1 AS layer, p_partkey * 4 AS line, CAST(p_partkey AS STRING) AS id, '20240101' AS effective_time, CASE WHEN p_partkey % 11 = 0 THEN '0' ELSE '1' END AS active, 'm1' AS module_id, '{CTV3_MAP}' AS refset_id, {_id(5, "p_partkey")} AS referenced_component_id, CASE WHEN p_partkey % 6 = 0 THEN '  ' ELSE ' ' || p_brand || '-' || CAST(p_size AS STRING) || ' ' END AS map_target FROM @part
  UNION ALL SELECT 1, p_partkey * 4 + 1, CAST(p_partkey AS STRING) || 'x', '20240101', '1', 'm1', CASE WHEN p_partkey % 2 = 0 THEN '111' ELSE '{CTV3_MAP}' END, {_id(5, "p_partkey")}, 'A' || CAST(p_size AS STRING) FROM @part WHERE p_partkey % 3 = 1
  UNION ALL SELECT 2, p_partkey * 4, CAST(p_partkey AS STRING), '20240301', '1', 'm3', '{CTV3_MAP}', {_id(5, "p_partkey")}, p_brand || '-' || CAST(p_size AS STRING) FROM @part WHERE p_partkey % 7 = 2
), refset_rows AS (
  SELECT 1 AS layer, c_custkey * 2 AS line, CAST(c_custkey AS STRING) AS id, '20240101' AS effective_time, '1' AS active, 'm1' AS module_id, {_id(8, "k")} AS refset_id, {_id(3, "c_custkey")} AS referenced_component_id FROM @customer JOIN seg ON name = c_mktsegment
  UNION ALL SELECT 1, c_custkey * 2 + 1, CAST(c_custkey AS STRING) || 'x', '20240101', CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE '1' END, 'm1', '777', {_id(3, "c_custkey")} FROM @customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 2, c_custkey, CAST(c_custkey AS STRING) || 'y', '20240301', '1', 'm3', '777', {_id(3, "c_custkey")} FROM @customer WHERE c_custkey % 6 = 3
)"""

KINDS = {"concept": "concept_rows", "description": "description_rows", "relationship": "relationship_rows", "language_refset": "language_rows", "simple_map": "map_rows", "simple_refset": "refset_rows"}


def sql(then: str, names: str = "") -> str:
    """A statement over the tables of rows; names comes before the tables' names."""
    rows = ROWS
    for t in TABLES:
        rows = rows.replace(f"@{t}", names + t)
    return f"WITH RECURSIVE {rows[1:]}{then}" if not names else f"WITH {rows[1:]}{then}"


def rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(layer, line, columns of the format) of one kind of file."""
    for t in TABLES:
        surrogate.table(spark, sf_dir, t).createOrReplaceTempView(f"surrogate_release_{t}")
    return spark.sql(sql(f" SELECT * FROM {KINDS[kind]}", "surrogate_release_"))


def _write(df: DataFrame, folder: str, name: str) -> None:
    """Rows in line order as FILES files NAME00000.txt ..., each with a header."""
    spark = df.sparkSession
    staged = f"{folder}/.{name}"
    df.repartitionByRange(FILES, "line").sortWithinPartitions("line").drop("layer", "line").write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in fs.listStatus(path(staged)) if f.getPath().getName().startswith("part-"))
    for k, part in enumerate(parts):
        fs.rename(path(f"{staged}/{part}"), path(f"{folder}/{name}{k:05d}.txt"))
    fs.delete(path(staged), True)


_WRITTEN: dict[tuple[str, str], list[str]] = {}


def folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The two layers' folders, written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        at = shared.folder(spark, "release")
        for kind in KINDS:
            df = rows(spark, sf_dir, kind)
            for layer in (1, 2):
                _write(df.where(F.col("layer") == layer), f"{at}/layer{layer}/Snapshot", f"{PREFIXES[kind][0]}{'' if PREFIXES[kind][0].endswith('_') else '_'}Snapshot_")
        _WRITTEN[key] = [f"{at}/layer1", f"{at}/layer2"]
    return _WRITTEN[key]


def built_sql(then: str, inactive: str = "drop", language: str = "en", refset: str | None = None) -> str:
    """A statement over `built`: the records that the release makes, nested columns as text.

    inactive: "drop" (an earlier active row counts), "keep", or "retract" (the last row decides).
    """
    where = "" if inactive != "drop" else "WHERE active = '1'"
    having = "HAVING arg_max(active, o) = '1'" if inactive == "retract" else ""
    only = f"AND refset_id = '{refset}'" if refset else ""
    fields = [f.name for f in RELEASE_FILES["concept"].fields]
    assert fields[0] == "id"
    o = "layer * 1000000000000 + line AS o"
    return sql(
        f""", kept AS (SELECT id, arg_max(module_id, o) AS module, arg_max(effective_time, o) AS effective_time, arg_max(active, o) = '1' AS active FROM (SELECT *, {o} FROM concept_rows) {where} GROUP BY id {having}),
acc AS (SELECT referenced_component_id AS d, arg_max(acceptability_id, o) = '{PREFERRED}' AS preferred FROM (SELECT *, {o} FROM language_rows) WHERE active = '1' {only} GROUP BY 1),
said AS (SELECT r.concept_id, r.term, r.type_id, r.language_code, r.o, coalesce(preferred, false) AS preferred FROM (SELECT *, {o} FROM description_rows WHERE active = '1') r JOIN kept ON kept.id = r.concept_id LEFT JOIN acc ON acc.d = r.id),
named AS (SELECT concept_id AS id, arg_min(term, o) AS fsn, regexp_replace(arg_min(term, o), ' \\([^(]*$', '') AS label FROM said WHERE type_id = '{FSN_TYPE}' GROUP BY 1),
pick AS (SELECT concept_id AS id, arg_min(term, o) FILTER (preferred AND starts_with(language_code, '{language}')) AS own, arg_min(term, o) FILTER (preferred) AS other FROM said WHERE type_id = '{SYNONYM_TYPE}' GROUP BY 1),
termed AS (SELECT kept.id, coalesce(fsn, '') AS fsn, coalesce(own, other, label, '') AS preferred_term FROM kept LEFT JOIN named USING (id) LEFT JOIN pick USING (id)),
syn AS (SELECT t.id, string_agg(term, '|' ORDER BY o) AS synonyms FROM termed t JOIN said ON concept_id = t.id WHERE type_id = '{SYNONYM_TYPE}' AND term <> preferred_term GROUP BY 1),
edge AS (SELECT source_id AS child, destination_id AS parent, {o} FROM relationship_rows WHERE active = '1' AND type_id = '{IS_A}'),
ups AS (SELECT child AS id, string_agg(parent || '=' || coalesce(fsn, ''), ';' ORDER BY parent, coalesce(fsn, '')) AS parents FROM edge LEFT JOIN named ON named.id = parent GROUP BY 1),
kid AS (SELECT parent AS id, count(*) AS children_count FROM edge GROUP BY 1),
fp AS (SELECT child, arg_min(parent, o) AS parent FROM edge GROUP BY 1),
walk AS (
  SELECT id, id AS at, coalesce(label, '') AS at_label, [coalesce(label, '')] AS path, '' AS hierarchy, 0 AS n FROM kept LEFT JOIN named USING (id)
  UNION ALL SELECT w.id, fp.parent, coalesce(l.label, ''), CASE WHEN l.label IS NOT NULL THEN list_prepend(l.label, w.path) ELSE w.path END, CASE WHEN fp.parent = '{ROOT}' THEN w.at_label ELSE w.hierarchy END, w.n + 1
  FROM walk w JOIN fp ON fp.child = w.at LEFT JOIN named l ON l.id = fp.parent WHERE w.n < 20
), far AS (SELECT id, arg_max(hierarchy, n) AS hierarchy, array_to_string(arg_max(path, n), '>') AS path FROM walk GROUP BY id),
att AS (SELECT source_id AS id, type_id, string_agg(destination_id || '=' || coalesce(fsn, ''), ',' ORDER BY destination_id) AS refs FROM relationship_rows r LEFT JOIN named ON named.id = destination_id WHERE r.active = '1' AND type_id <> '{IS_A}' GROUP BY 1, 2),
atts AS (SELECT id, string_agg(CASE type_id WHEN '363698007' THEN 'finding_site' WHEN '116676008' THEN 'associated_morphology' ELSE type_id END || ':' || refs, ';' ORDER BY type_id) AS attributes FROM att GROUP BY 1),
code AS (SELECT referenced_component_id AS id, array_to_string(list_sort(list(DISTINCT trim(map_target))), ',') AS ctv3_codes FROM map_rows WHERE active = '1' AND refset_id = '{CTV3_MAP}' AND trim(map_target) <> '' GROUP BY 1),
sets AS (SELECT referenced_component_id AS id, array_to_string(list_sort(list(DISTINCT refset_id)), ',') AS refsets FROM refset_rows WHERE active = '1' GROUP BY 1),
built AS (SELECT kept.id, fsn, preferred_term, coalesce(synonyms, '') AS synonyms, hierarchy, path, coalesce(parents, '') AS parents, coalesce(children_count, 0) AS children_count, active, module, effective_time, coalesce(attributes, '') AS attributes, coalesce(ctv3_codes, '') AS ctv3_codes, coalesce(refsets, '') AS refsets
  FROM kept JOIN termed USING (id) JOIN far USING (id) LEFT JOIN syn USING (id) LEFT JOIN ups USING (id) LEFT JOIN kid USING (id) LEFT JOIN atts USING (id) LEFT JOIN code USING (id) LEFT JOIN sets USING (id)) """
        + then
    )


def as_text(records: DataFrame) -> DataFrame:
    """Records with nested columns as text, as `built` has them."""
    ref = lambda x: F.concat(x["id"], F.lit("="), x["fsn"])
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return records.select(
        "id", "fsn", "preferred_term", joined("synonyms", "|"), "hierarchy", F.array_join("hierarchy_path", ">").alias("path"), F.array_join(F.transform("parents", ref), ";").alias("parents"), "children_count", "active", "module", "effective_time",
        F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], ref), ","))), ";").alias("attributes"), joined("ctv3_codes", ","), joined("refsets", ","),
    )
