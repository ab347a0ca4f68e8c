"""Release rows to one canonical record for each concept.

Every "first" and "last" goes by ord, the order in the files, taken before any
shuffle. All groupings are by concept (or description) id, so Catalyst can
keep one partitioning for most joins; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attribute_label, strip_tag
from ..schema import CTV3_MAP, FSN_TYPE, IS_A, PREFERRED, ROOT, SCHEMA_VERSION, SYNONYM_TYPE, WALK_LIMIT
from .hierarchy import first_parent_paths


def last_row(df: DataFrame, key: str, ord_: str = "ord") -> DataFrame:
    """The last row for each key, by one aggregation with map-side combining."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ord_)).alias("__r")).select(key, *[F.col("__r").getField(c).alias(c) for c in rest])


def active_concepts(concepts: DataFrame, include_inactive: bool = False, retract: bool = False) -> DataFrame:
    """Active concepts, the last row of each id.

    By default a later inactive row doesn't remove an earlier active one;
    retract lets the last row decide. include_inactive keeps inactive ids too.
    """
    if include_inactive:
        return last_row(concepts, "id")
    return last_row(concepts, "id").where("active") if retract else last_row(concepts.where("active"), "id")


def acceptability(language: DataFrame, refset: str | None = None) -> DataFrame:
    """(description, preferred): the last active row of each description, over all language refsets unless one is named."""
    rows = language.where("active")
    if refset is not None:
        rows = rows.where(F.col("refset_id") == refset)
    return rows.groupBy(F.col("referenced_component_id").alias("description")).agg(F.max_by(F.col("acceptability_id") == PREFERRED, "ord").alias("preferred"))


def terms(concepts: DataFrame, descriptions: DataFrame, accepted: DataFrame, locale: str = "en-GB") -> DataFrame:
    """(id, fsn, preferred_term, synonyms) of each concept.

    The preferred term is the first preferred synonym in the locale's
    language, else the first preferred synonym, else the name without its tag.
    """
    language = locale.split("-")[0]
    own = descriptions.where("active").join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    d = own.join(accepted, own["id"] == accepted["description"], "left").withColumn("preferred", F.coalesce("preferred", F.lit(False)))
    is_fsn, is_syn = F.col("type_id") == FSN_TYPE, F.col("type_id") == SYNONYM_TYPE
    first = lambda cond: F.min_by("term", F.when(cond, F.col("ord")))  # noqa: E731  rows without an ord don't count
    g = d.groupBy("concept_id").agg(
        F.coalesce(first(is_fsn), F.lit("")).alias("fsn"),
        first(is_syn & F.col("preferred") & F.col("language_code").startswith(language)).alias("local"),
        first(is_syn & F.col("preferred")).alias("any"),
        F.collect_list(F.when(is_syn, F.struct("ord", "term"))).alias("syn"),
    )
    t = concepts.select("id").join(g, concepts["id"] == g["concept_id"], "left").withColumn("fsn", F.coalesce("fsn", F.lit("")))
    t = t.withColumn("preferred_term", F.coalesce("local", "any", strip_tag(F.col("fsn"))))
    ordered = F.transform(F.array_sort(F.coalesce("syn", F.array().cast("array<struct<ord:struct<file:int,block:bigint,row:bigint>,term:string>>"))), lambda x: x["term"])
    return t.select("id", "fsn", "preferred_term", F.filter(ordered, lambda x: x != F.col("preferred_term")).alias("synonyms"))


def relationships(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(is-a edges as child_id, parent_id, ord; attribute rows), the active ones, whatever the concepts' activity."""
    on = rows.where("active")
    isa = on.where(F.col("type_id") == IS_A).select(F.col("source_id").alias("child_id"), F.col("destination_id").alias("parent_id"), "ord")
    return isa, on.where(F.col("type_id") != IS_A)


def fsn_names(descriptions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, name): the first fully specified name of each kept concept."""
    own = descriptions.where("active").where(F.col("type_id") == FSN_TYPE).join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    return own.groupBy(F.col("concept_id").alias("id")).agg(F.min_by("term", "ord").alias("name"))


def _named(edges: DataFrame, key: str, names: DataFrame) -> DataFrame:
    n = names.select(F.col("id").alias("__id"), "name")
    return edges.join(n, edges[key] == n["__id"], "left").withColumn("name", F.coalesce("name", F.lit(""))).drop("__id")


def parents(isa: DataFrame, names: DataFrame) -> DataFrame:
    """(id, parents): each edge's parent with its name, sorted by id, repeats kept."""
    e = _named(isa, "parent_id", names)
    return e.groupBy(F.col("child_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("parent_id").alias("id"), F.col("name").alias("fsn")))).alias("parents"))


def children_counts(isa: DataFrame) -> DataFrame:
    """(id, children_count): edges that end in each id."""
    return isa.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children_count"))


def attributes(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(id, attributes): targets by type, types and targets sorted by id, keyed by label."""
    a = _named(rows, "destination_id", names)
    by_type = a.groupBy("source_id", "type_id").agg(F.sort_array(F.collect_list(F.struct(F.col("destination_id").alias("id"), F.col("name").alias("fsn")))).alias("refs"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("type_id", "refs"))), lambda x: F.struct(attribute_label(x["type_id"]), x["refs"]))
    return by_type.groupBy(F.col("source_id").alias("id")).agg(F.map_from_entries(entries).alias("attributes"))


def codes(simple_map: DataFrame, refset: str = CTV3_MAP) -> DataFrame:
    """(id, codes): distinct targets of one map refset, sorted."""
    on = simple_map.where("active").where(F.col("refset_id") == refset)
    return on.groupBy(F.col("referenced_component_id").alias("id")).agg(F.sort_array(F.collect_set("map_target")).alias("codes"))


def memberships(simple_refset: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, refsets): distinct refsets of each kept concept, sorted."""
    on = simple_refset.where("active").join(concepts.select(F.col("id").alias("referenced_component_id")), "referenced_component_id", "left_semi")
    return on.groupBy(F.col("referenced_component_id").alias("id")).agg(F.sort_array(F.collect_set("refset_id")).alias("refsets"))


def build(release: dict[str, DataFrame], locale: str = "en-GB", include_inactive: bool = False, retract: bool = False, language_refset: str | None = None, root: str = ROOT) -> DataFrame:
    """The canonical records of a release, one row for each concept, in no particular order."""
    concepts = active_concepts(release["concept"], include_inactive, retract)
    isa, attribute_rows = relationships(release["relationship"])
    names = fsn_names(release["description"], concepts)
    walks = first_parent_paths(concepts.select("id"), isa, names, root, WALK_LIMIT)
    out = concepts.select("id", "active", F.col("module_id").alias("module"), "effective_time")
    for part in (
        terms(concepts, release["description"], acceptability(release["language_refset"], language_refset), locale), walks, parents(isa, names),
        children_counts(isa), attributes(attribute_rows, names), codes(release["simple_map"]), memberships(release["simple_refset"], concepts),
    ):
        out = out.join(part, "id", "left")
    none = lambda t: F.array().cast(t)
    ref = "struct<id:string,fsn:string>"

    def col(name: str, default: Column) -> Column:
        return F.coalesce(name, default).alias(name)

    return out.select(
        "id", "fsn", "preferred_term", "synonyms", col("hierarchy", F.lit("")), col("hierarchy_path", none("array<string>")), col("parents", none(f"array<{ref}>")),
        col("children_count", F.lit(0).cast("long")), "active", "module", "effective_time", col("attributes", F.create_map().cast(f"map<string,array<{ref}>>")),
        F.coalesce("codes", none("array<string>")).alias("ctv3_codes"), none("array<string>").alias("read2_codes"), col("refsets", none("array<string>")), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def edges_of(records: DataFrame) -> DataFrame:
    """(child_id, parent_id) of records, distinct."""
    return records.select(F.col("id").alias("child_id"), F.explode("parents.id").alias("parent_id")).distinct()


def maps_of(records: DataFrame) -> DataFrame:
    """(code, terminology, concept_id) of records: ctv3 and read2 codes."""
    one = lambda c, t: records.select(F.explode(c).alias("code"), F.lit(t).alias("terminology"), F.col("id").alias("concept_id"))
    return one("ctv3_codes", "ctv3").unionAll(one("read2_codes", "read2"))


def members_of(records: DataFrame) -> DataFrame:
    """(refset_id, referenced_component_id) of records, distinct."""
    return records.select(F.explode("refsets").alias("refset_id"), F.col("id").alias("referenced_component_id")).distinct()
