"""Queries over release files: what is read of each kind, what the build makes of it, and round trips of its products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from .. import surrogate_release as R
from ..operators import build as B
from ..operators import hierarchy as H
from ..operators import sinks as K
from ..plans import artefacts
from ..plans.terminology import Terminology
from ..schema import RELEASE_FILES, ROOT
from ..sources import records, release

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder of tables) under its name."""

    def put(f: Callable):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _release(spark: SparkSession, sf_dir: str, **options) -> dict[str, DataFrame]:
    return release.read_release(spark, R.folders(spark, sf_dir), **options)


def _kind(kind: str) -> None:
    columns = [f.name for f in RELEASE_FILES[kind].fields]
    target = "trim(map_target)"
    wanted = ", ".join("active = '1' AS active" if c == "active" else f"{target} AS {c}" if c == "map_target" else c for c in columns)
    where = f" WHERE {target} <> ''" if kind == "simple_map" else ""

    name = f"rf2_{kind}_rows"
    Q[name] = lambda spark, sf_dir: _release(spark, sf_dir)[kind].select(*columns)
    SQL[name] = R.sql(f" SELECT {wanted} FROM {R.KINDS[kind]}{where}")


for _k in R.KINDS:
    _kind(_k)


_BUILT: dict[tuple, DataFrame] = {}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the release, built once for each application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        at = shared.folder(spark, "records")
        B.build(_release(spark, sf_dir)).write.parquet(at)
        _BUILT[key] = spark.read.parquet(at)
    return _BUILT[key]


_ALL = "SELECT * FROM built"


@query(R.built_sql(_ALL))
def rf2_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every record, from the files."""
    return R.as_text(B.build(_release(spark, sf_dir)))


@query(R.built_sql(_ALL, inactive="keep"))
def rf2_build_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_text(B.build(_release(spark, sf_dir), include_inactive=True))


@query(R.built_sql(_ALL, inactive="retract"))
def rf2_build_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_text(B.build(_release(spark, sf_dir), retract=True))


@query(R.built_sql(_ALL, language="fr", refset="901"))
def rf2_build_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in another language, by one language refset."""
    return R.as_text(B.build(_release(spark, sf_dir), locale="fr-FR", language_refset="901"))


@query(R.built_sql("SELECT id, fsn, preferred_term, synonyms, '' AS refsets FROM built"))
def rf2_without_refsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_text(B.build(_release(spark, sf_dir, refsets="none"))).select("id", "fsn", "preferred_term", "synonyms", "refsets")


@query(R.built_sql("SELECT id, fsn, preferred_term, synonyms FROM built"))
def preferred_term_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _release(spark, sf_dir)
    return B.terms(B.active_concepts(r["concept"]), r["description"], B.acceptability(r["language_refset"])).select("id", "fsn", "preferred_term", F.array_join("synonyms", "|").alias("synonyms"))


@query(R.built_sql("SELECT id, parents FROM built WHERE parents <> ''"))
def rf2_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _release(spark, sf_dir)
    kept = B.active_concepts(r["concept"])
    up = B.parents(B.relationships(r["relationship"])[0], B.fsn_names(r["description"], kept)).join(kept.select("id"), "id", "left_semi")
    return up.select("id", F.array_join(F.transform("parents", lambda x: F.concat(x["id"], F.lit("="), x["fsn"])), ";").alias("parents"))


@query(R.built_sql("SELECT id, hierarchy, path FROM built"))
def rf2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _release(spark, sf_dir)
    kept = B.active_concepts(r["concept"])
    walk = H.first_parent_paths(kept.select("id"), B.relationships(r["relationship"])[0], B.fsn_names(r["description"], kept), ROOT)
    return walk.select("id", "hierarchy", F.array_join("hierarchy_path", ">").alias("path"))


@query(R.built_sql("SELECT id, attributes, ctv3_codes, refsets FROM built"))
def rf2_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from archives: each layer zipped, extracted and read."""
    return R.as_text(B.build(release.read_release(spark, _zipped(spark, sf_dir)))).select("id", "attributes", "ctv3_codes", "refsets")


def _zipped(spark: SparkSession, sf_dir: str) -> list[str]:
    import os
    import zipfile

    out = []
    for folder in R.folders(spark, sf_dir):
        top = folder.removeprefix("file://")
        to = f"{os.path.dirname(top)}/{os.path.basename(top)}.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(p for found in release.discover(top).values() for p in found):
                z.write(path, f"top/{os.path.relpath(path, top)}")
        out.append(to)
    return out


@query(R.built_sql(_ALL))
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column, written as NDJSON and read again."""
    at = shared.folder(spark, "ndjson")
    K.write_ndjson(_records(spark, sf_dir), at)
    return R.as_text(records.read_ndjson(spark, at))


@query(R.built_sql(_ALL))
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column, written as nested Parquet and read again."""
    at = shared.folder(spark, "parquet")
    K.write_parquet(_records(spark, sf_dir), at)
    return R.as_text(records.read_parquet(spark, at))


@query(R.built_sql("SELECT id, fsn, preferred_term, synonyms, hierarchy, path, parents, children_count, active, module, effective_time, attributes, '' AS ctv3_codes, '' AS refsets FROM built"))
def parquet_flat_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen columns of the flat Parquet form, written with JSON text and read again."""
    at = shared.folder(spark, "parquet-flat")
    K.write_parquet(_records(spark, sf_dir), at, nested=False)
    return R.as_text(records.read_parquet(spark, at))


@query(R.built_sql(", i AS (SELECT DISTINCT child AS child_id, parent AS parent_id FROM edge JOIN kept ON kept.id = child), m AS (SELECT DISTINCT refset_id, referenced_component_id FROM refset_rows r JOIN kept ON kept.id = referenced_component_id WHERE r.active = '1'), c AS (SELECT trim(map_target) AS code, min(referenced_component_id) AS concept_id FROM map_rows r JOIN kept ON kept.id = referenced_component_id WHERE r.active = '1' AND refset_id = '900000000000497000' AND trim(map_target) <> '' GROUP BY 1) SELECT 'isa' AS name, child_id AS a, parent_id AS b FROM i UNION ALL SELECT 'member', refset_id, referenced_component_id FROM m UNION ALL SELECT 'map', code, concept_id FROM c UNION ALL SELECT 'concept', id, fsn FROM built"))
def relational_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the four relational tables, written and read again."""
    at = shared.folder(spark, "tables")
    K.write_tables(_records(spark, sf_dir), at)
    pair = lambda table, name, a, b: spark.read.parquet(f"{at}/{table}").select(F.lit(name).alias("name"), F.col(a).alias("a"), F.col(b).alias("b"))
    return pair("concept_isa", "isa", "child_id", "parent_id").unionAll(pair("refset_members", "member", "refset_id", "referenced_component_id")).unionAll(pair("concept_maps", "map", "code", "concept_id")).unionAll(pair("concepts", "concept", "id", "fsn"))


_MADE: dict[tuple, dict[str, str]] = {}


def _artefacts(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = artefacts.make(spark, R.folders(spark, sf_dir), shared.folder(spark, "artefacts"))
    return _MADE[key]


_CLOSED = ", hop AS (SELECT DISTINCT child, parent FROM edge WHERE child <> parent), rise AS (SELECT child AS low, parent AS high, 1 AS depth FROM hop UNION SELECT low, parent, depth + 1 FROM rise JOIN hop ON child = high), closed AS (SELECT high AS ancestor_id, low AS descendant_id, min(depth) AS depth FROM rise JOIN kept ON kept.id = low GROUP BY ALL) "


def _isa_of_records(then: str) -> str:
    """As the closure goes by the records' edges, those of kept concepts alone."""
    return R.built_sql(_CLOSED.replace("FROM edge WHERE", "FROM edge JOIN kept k2 ON k2.id = child WHERE") + then)


@query(_isa_of_records("SELECT ancestor_id, descendant_id, depth FROM closed"))
def rf2_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure as an artefact: written, read again."""
    return artefacts.load(spark, _artefacts(spark, sf_dir)).closed


@query(_isa_of_records("SELECT depth, id, preferred_term FROM closed JOIN built ON id = ancestor_id WHERE descendant_id = '3000000007'"))
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefacts.load(spark, _artefacts(spark, sf_dir)).chain("3000000007")


@query(_isa_of_records("SELECT 'concepts' AS name, count(*) AS n FROM built UNION ALL SELECT 'records', count(*) FROM built UNION ALL SELECT 'concept_isa', (SELECT count(DISTINCT child || '>' || parent) FROM edge JOIN kept ON kept.id = child) UNION ALL SELECT 'concept_ancestors', (SELECT count(*) FROM closed) UNION ALL SELECT 'refset_members', (SELECT count(DISTINCT refset_id || referenced_component_id) FROM refset_rows r JOIN kept ON kept.id = referenced_component_id WHERE r.active = '1') UNION ALL SELECT 'concept_maps', (SELECT count(DISTINCT trim(map_target)) FROM map_rows r JOIN kept ON kept.id = referenced_component_id WHERE r.active = '1' AND refset_id = '900000000000497000' AND trim(map_target) <> '')"))
def artefact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the written tables, but for the index, which DuckDB would have to cut into words."""
    return artefacts.table_counts(spark, {k: v for k, v in _artefacts(spark, sf_dir).items() if k != "index"})


_WORDS = ", t AS (SELECT id, unnest(regexp_extract_all(lower(id || ' ' || preferred_term || ' ' || replace(synonyms, '|', ' ') || ' ' || fsn), '[\\p{L}\\p{N}]+')) AS token FROM built), len AS (SELECT id, count(*) AS dl FROM t GROUP BY id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM len), tf AS (SELECT token, id, count(*) AS f FROM t WHERE token IN ('brand', 'part') GROUP BY ALL), df AS (SELECT token, count(*) AS d FROM tf GROUP BY token), scored AS (SELECT tf.id, round(sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN df USING (token) JOIN len ON len.id = tf.id, st GROUP BY tf.id) "


@query(R.built_sql(_WORDS + "SELECT id, preferred_term, score FROM scored JOIN built USING (id) ORDER BY score DESC, id LIMIT 10"))
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best matches, through the written index."""
    t = artefacts.load(spark, _artefacts(spark, sf_dir))
    return t.search("brand OR part", 10).select("id", "preferred_term", F.round("score", 6).alias("score"))


@query(_isa_of_records(_WORDS + "SELECT id, preferred_term, active FROM built WHERE id IN (SELECT descendant_id FROM closed WHERE ancestor_id = '900000001') AND id IN (SELECT id FROM t WHERE token LIKE 'bra%') ORDER BY preferred_term, id LIMIT 20"))
def search_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text within what an expression describes."""
    return artefacts.load(spark, _artefacts(spark, sf_dir)).expand("descendants of 900000001", "bra*", 0, 20)


@query(_isa_of_records("SELECT a.child AS a, b.id AS b, CASE WHEN a.child = b.id THEN 'equivalent' WHEN EXISTS (SELECT 1 FROM closed WHERE descendant_id = a.child AND ancestor_id = b.id) THEN 'subsumed-by' WHEN EXISTS (SELECT 1 FROM closed WHERE descendant_id = b.id AND ancestor_id = a.child) THEN 'subsumes' ELSE 'not-subsumed' END AS outcome FROM (SELECT DISTINCT child FROM edge JOIN kept ON kept.id = child) a, (SELECT unnest(['900000001', '138875005', '3000000007']) AS id) b"))
def subsumption_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome for every child of an edge against three concepts."""
    t = artefacts.load(spark, _artefacts(spark, sf_dir))
    pairs = t.isa.select(F.col("child_id").alias("a")).distinct().select("a", F.explode(F.array(*[F.lit(x) for x in ("900000001", ROOT, "3000000007")])).alias("b"))
    return t.subsumptions(pairs)
