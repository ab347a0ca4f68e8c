"""Schemas of release files and of the canonical concept record, and the ids that carry meaning."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 3

# Ids of the release format.
ROOT = "138875005"
IS_A = "116680003"
FSN_TYPE = "900000000000003001"
SYNONYM_TYPE = "900000000000013009"
PREFERRED = "900000000000548007"
CTV3_MAP = "900000000000497000"

# Attribute type ids and their labels; other ids stand for themselves.
ATTRIBUTE_LABELS = {
    "363698007": "finding_site",
    "116676008": "associated_morphology",
    "47429007": "associated_with",
    "255234002": "after",
    "246454002": "occurrence",
    "246090004": "associated_finding",
    "263502005": "clinical_course",
    "246456000": "episodicity",
    "363714003": "interprets",
    "363713009": "has_interpretation",
    "370135005": "pathological_process",
    "363709002": "associated_procedure",
    "405816004": "procedure_site_direct",
    "405815000": "procedure_site_indirect",
    "260686004": "method",
    "405813007": "procedure_site",
    "246093002": "component",
    "704319004": "inheres_in",
    "704318007": "property_type",
    "704321009": "characterizes",
    "370132008": "scale_type",
    "246501002": "technique",
    "411116001": "has_dose_form",
    "127489000": "has_active_ingredient",
    "762949000": "has_precise_active_ingredient",
}

#: The walk to the root follows first parents for so many steps at most.
WALK_LIMIT = 20


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_HEAD = ("id", "effective_time", "active", "module_id")
RELEASE_FILES: dict[str, T.StructType] = {
    "concept": strings(*_HEAD, "definition_status_id"),
    "description": strings(*_HEAD, "concept_id", "language_code", "type_id", "term", "case_significance_id"),
    "relationship": strings(*_HEAD, "source_id", "destination_id", "relationship_group", "type_id", "characteristic_type_id", "modifier_id"),
    "language_refset": strings(*_HEAD, "refset_id", "referenced_component_id", "acceptability_id"),
    "simple_map": strings(*_HEAD, "refset_id", "referenced_component_id", "map_target"),
    "simple_refset": strings(*_HEAD, "refset_id", "referenced_component_id"),
}

REF = T.StructType([T.StructField("id", T.StringType()), T.StructField("fsn", T.StringType())])
CONCEPT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fsn", T.StringType()),
        T.StructField("preferred_term", T.StringType()),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("hierarchy", T.StringType()),
        T.StructField("hierarchy_path", T.ArrayType(T.StringType())),
        T.StructField("parents", T.ArrayType(REF)),
        T.StructField("children_count", T.LongType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("module", T.StringType()),
        T.StructField("effective_time", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.ArrayType(REF))),
        T.StructField("ctv3_codes", T.ArrayType(T.StringType())),
        T.StructField("read2_codes", T.ArrayType(T.StringType())),
        T.StructField("refsets", T.ArrayType(T.StringType())),
        T.StructField("schema_version", T.IntegerType()),
    ]
)
