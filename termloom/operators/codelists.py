"""Code lists: files of a header and concept lines, as DataFrames of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_field, padded
from .hierarchy import descendants

# Header fields that a file must have, and the beginning of text not yet filled in.
REQUIRED = ("id", "title", "description", "terminology", "created", "updated", "version", "status", "licence", "copyright", "appropriate_use", "misuse")
PLACEHOLDER = "Describe"

_WS = r"[\s]"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, body, error) of every .codelist file below a folder, or of one file; a bad file has an error instead of a body."""
    reader = spark.read.option("recursiveFileLookup", True)
    if not path.endswith(".codelist"):
        reader = reader.option("pathGlobFilter", "*.codelist")
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿+", "").alias("t"))
    opened = F.col("t").rlike(r"^---\r?\n")
    rest = F.regexp_replace("t", r"^---\r?\n", "")
    at = F.instr(rest, "\n---")
    error = F.when(~opened, F.lit("the file must start with '---'")).when(at == 0, F.lit("the header isn't closed by '---'"))
    header = F.when(error.isNull(), F.substring(rest, F.lit(1), at - 1))
    body = F.when(error.isNull(), F.regexp_replace(F.substring(rest, at + 4, F.length(rest)), r"^[\r\n]+", ""))
    missing = F.filter(F.array(*[F.lit(f) for f in REQUIRED]), lambda f: ~F.regexp(header, F.concat(F.lit(r"(?m)^"), f, F.lit(r":"))))
    error = F.coalesce(error, F.when(F.size(missing) > 0, F.concat(F.lit("the header lacks "), F.array_join(missing, ", "))))
    return raw.select("file", header.alias("header"), body.alias("body"), error.alias("error"))


def fields(header: str) -> dict[str, str]:
    """Top-level scalar fields of a header; runs on the driver, for one file. Nested fields are left as they are written."""
    out: dict[str, str] = {}
    for m in re.finditer(r"(?m)^([A-Za-z_]+):[ \t]*(.*(?:\n[ \t-].*)*)$", header):
        v = m[2].strip()
        out[m[1]] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, raw) of the bodies."""
    return files.where("error is null").select("file", F.posexplode(F.split(F.regexp_replace("body", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "raw"))


def classified(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with kind (blank, pending, excluded, comment, active), code, term and comment."""
    t = F.regexp_replace(F.col(raw), r"^\s+|\s+$", "")
    after = F.regexp_replace(F.regexp_replace(t, r"^#\s*", ""), r"\s+$", "")
    asked = F.regexp_replace(after, r"^\?\s*", "")
    pending = t.startswith("#") & after.startswith("?") & asked.rlike(r"^[0-9]*\s")
    excluded = t.startswith("#") & after.rlike(r"^[0-9][^\s]*\s")
    active = ~t.startswith("#") & t.rlike(r"^[0-9][^\s]*\s")
    kind = F.when(t == "", "blank").when(pending, "pending").when(excluded, "excluded").when(active, "active").otherwise("comment")
    body = F.when(pending, asked).when(excluded, after).when(active, t)
    code = F.regexp_extract(body, r"^(\S*)\s", 1)
    rest = F.regexp_replace(body, r"^\S*\s+", "")
    cut = F.instr(rest, " #")
    term = F.when(pending, F.trim(rest)).when(cut > 0, F.trim(F.substring(rest, F.lit(1), cut - 1))).otherwise(F.trim(rest))
    note = F.when(~pending & (cut > 0), F.trim(F.substring(rest, cut + 2, F.length(rest))))
    note = F.when(F.col("kind") == "comment", t).when(note != "", note)
    keep = F.col("kind").isin("pending", "excluded", "active")
    return rows.withColumn("kind", kind).withColumn("code", F.when(keep, code)).withColumn("term", F.when(keep, term)).withColumn("comment", note)


def rendered(kind: Column, code: Column, term: Column, comment: Column) -> Column:
    """The line of a file."""
    tail = F.when(comment.isNotNull(), F.concat(F.lit("  # "), comment)).otherwise(F.lit(""))
    return (
        F.when(kind == "active", F.concat(padded(code, 14), F.lit(" "), term, tail))
        .when(kind == "excluded", F.concat(F.lit("# "), padded(code, 13), F.lit(" "), term, tail))
        .when(kind == "pending", F.concat(F.lit("# ? "), code, F.lit("  "), term))
        .when(kind == "comment", comment)
        .otherwise(F.lit(""))
    )


def document(header: str, rows: DataFrame) -> DataFrame:
    """(text): a whole file from its header and lines (line_no, kind, code, term, comment); a code list is one document."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", rendered(F.col("kind"), F.col("code"), F.col("term"), F.col("comment")).alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit(f"---\n{header.rstrip(chr(10))}\n---\n"), F.when(F.count("*") > 0, F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise(F.lit(""))).alias("text"))


# The codes of a new list's warnings, how severe they are, and the terminologies that they are for (None: any).
WARNINGS = (
    ("not-universal-definition", "info", None),
    ("draft-not-reviewed", "info", None),
    ("snomed-release-age", "caution", "SNOMED CT"),
    ("dmd-currency", "warning", "dm+d"),
    ("dmd-vmp-code-change", "caution", "dm+d"),
)
#: What the warnings say.
MESSAGES = {
    "not-universal-definition": "Made for one study; another may need a different list.",
    "draft-not-reviewed": "A draft that nobody has reviewed so far.",
    "snomed-release-age": "Compare it with the latest release first.",
    "dmd-currency": "Product codes are renewed often, so look for newer ones.",
    "dmd-vmp-code-change": "Some product codes may have been replaced; compare them with the latest release.",
}


def new(title: str, terminology: str, description: str | None = None, author: str | None = None, today: str = "1970-01-01", release: str | None = None) -> str:
    """The text of a new file; runs on the driver. release names the release that the list was made from."""
    name = re.sub(r" ", "-", title.lower())
    head = [f"id: {name}", f"title: {title}", f"description: {description or title + ' codes'}", f"terminology: {terminology}", f"created: '{today}'", f"updated: '{today}'", "version: 1", "status: draft", "licence: CC-BY-4.0", "copyright: To be named by the holder."]
    head += [f"appropriate_use: {PLACEHOLDER} what the list is good for.", f"misuse: {PLACEHOLDER} what it must not be taken for."]
    head += [f"snomed_release: '{release}'"] if release else []
    head += ["authors:", f"- name: {author}", "  role: author"] if author else []
    head += ["warnings:", *(x for code, severity, of in WARNINGS if of in (None, terminology) for x in (f"- code: {code}", f"  severity: {severity}", f"  message: {MESSAGES[code]}"))]
    return "---\n" + "\n".join(head) + "\n---\n\n\n# concepts\n\n"


def warnings(header: Column) -> Column:
    """array<struct<code, severity, message>>: the warnings of a header."""
    block = F.regexp_extract(header, r"(?m)^warnings:[ \t]*\n((?:[- ].*(?:\n|$))*)", 1)
    entries = F.filter(F.split(block, r"(?m)^- "), lambda x: F.trim(x) != "")
    field = lambda x, k: F.regexp_extract(x, rf"(?m)^\s*{k}:[ \t]*(.*)$", 1).alias(k)
    return F.transform(entries, lambda x: F.struct(*[field(x, k) for k in ("code", "severity", "message")]))


def added(rows: DataFrame, concepts: DataFrame, ids: DataFrame, isa: DataFrame | None = None, of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new active lines: code, term; ids that aren't concepts) for ids (column id) not active yet, and of's descendants if isa is given."""
    want = ids.select("id")
    if isa is not None and of is not None:
        want = want.unionAll(descendants(concepts, isa, of).select("id")).distinct()
    had = rows.where("kind = 'active'").select(F.col("code").alias("id"))
    fresh = want.join(had, "id", "left_anti")
    named = fresh.join(concepts.select("id", "preferred_term"), "id", "left")
    return named.where("preferred_term is not null").select(F.col("id").alias("code"), F.col("preferred_term").alias("term")), named.where("preferred_term is null").select("id")


def removed(rows: DataFrame, code: str, comment: str | None = None) -> DataFrame:
    """rows with the first active line of a code excluded and its comment replaced; an error while read if there is none."""
    first = rows.where((F.col("kind") == "active") & (F.col("code") == code)).agg(F.min("line_no").alias("first"))
    hit = F.col("line_no") == F.col("first")
    found = F.assert_true(F.col("first").isNotNull(), F.lit(f"{code} is not active")).isNull()
    cols = rows.columns
    j = rows.crossJoin(F.broadcast(first)).where(found)  # one row
    swap = {"kind": F.when(hit, F.lit("excluded")).otherwise(F.col("kind")), "comment": F.when(hit, F.lit(comment)).otherwise(F.col("comment"))}
    return j.select(*[(swap[c] if c in swap else F.col(c)).alias(c) for c in cols])


def repeated(rows: DataFrame) -> DataFrame:
    """(code, n): codes on several lines of any kind."""
    return rows.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where("n > 1")


def validated(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(severity, code, problem): repeated, missing, inactive, term_differs, pending."""
    c = concepts.select(F.col("id").alias("code"), F.col("preferred_term").alias("known"), F.col("active").alias("on"))
    a = rows.where("kind = 'active'").select("code", "term").join(c, "code", "left")
    problem = F.when(F.col("on").isNull(), "missing").when(~F.col("on"), "inactive").when(F.col("known") != F.col("term"), "term_differs")
    one = a.select(F.when(problem == "term_differs", "warning").otherwise("error").alias("severity"), "code", problem.alias("problem")).where("problem is not null")
    two = repeated(rows).select(F.lit("error").alias("severity"), "code", F.lit("repeated").alias("problem"))
    three = rows.where("kind = 'pending'").select(F.lit("warning").alias("severity"), "code", F.lit("pending").alias("problem"))
    return one.unionAll(two).unionAll(three)


def header_problems(head: dict[str, str], checked: tuple[str, ...] = ("appropriate_use", "misuse", "licence")) -> list[tuple[str, str]]:
    """(severity, field) of placeholders and, for a published list, missing signoffs; runs on the driver."""
    published = head.get("status") == "published"
    out = [("error" if published else "warning", f) for f in checked if not head.get(f, "").strip() or head[f].startswith(PLACEHOLDER)]
    if published and not head.get("signoffs", "").strip(" []\n"):
        out.append(("error", "signoffs"))
    return out


def stats(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(hierarchy, n, leaves, percent): active lines by hierarchy; leaves' percent is of all active lines."""
    a = rows.where("kind = 'active'").select(F.col("code").alias("id"))
    total = a.agg(F.count("*").alias("total"))
    n = a.join(concepts.select("id", "hierarchy", "children_count"), "id").groupBy("hierarchy").agg(F.count("*").alias("n"), F.count_if(F.col("children_count") == 0).alias("leaves"))
    return n.crossJoin(F.broadcast(total)).select("hierarchy", "n", "leaves", F.round(100.0 * F.col("leaves") / F.col("total"), 0).alias("leaf_percent"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, code, old_term, new_term): added, removed, moved to excluded, term changed; of a repeated code the last line counts."""
    last = lambda rows, p: rows.where("kind = 'active'").groupBy("code").agg(F.max_by("term", "line_no").alias(p))
    out = b.where("kind = 'excluded'").select("code").distinct().withColumn("out", F.lit(True))
    j = last(a, "old_term").withColumn("was", F.lit(True)).join(last(b, "new_term").withColumn("is", F.lit(True)), "code", "full").join(out, "code", "left")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull() & F.col("out").isNotNull(), "excluded").when(F.col("is").isNull(), "removed").when(F.col("old_term") != F.col("new_term"), "term_changed")
    return j.select(change.alias("change"), "code", "old_term", "new_term").where("change is not null")


def exported(rows: DataFrame, form: str = "csv", head: dict[str, str] | None = None) -> DataFrame:
    """(line_no, line): active lines as csv, opencodelists-csv or a markdown table (with the header's fields), what precedes them first."""
    a, h = rows.where("kind = 'active'"), head or {}
    # What the forms begin with.
    begin = {
        "csv": ["sctid,preferred_term"],
        "opencodelists-csv": ["code,term"],
        "markdown": [
            f"# {h.get('title', '')}", "", f"**Description:** {h.get('description', '')}", "",
            f"**Terminology:** {h.get('terminology', '')} | **Version:** {h.get('version', '')} | **Status:** {h.get('status', '')} | **Updated:** {h.get('updated', '')}", "",
            "| SCTID | Preferred Term |", "|---|---|",
        ],
    }
    if form not in begin:
        raise ValueError(f"unknown form {form!r}")
    if form == "markdown":
        line = F.concat(F.lit("| `"), F.col("code"), F.lit("` | "), F.col("term"), F.lit(" |"))
    else:
        line = F.concat(F.col("code"), F.lit(","), csv_field(F.col("term")))
    top = begin[form]
    first = rows.sparkSession.createDataFrame([(i - len(top), x) for i, x in enumerate(top)], "line_no int, line string")
    return first.unionAll(a.select(F.col("line_no").cast("int"), line.alias("line")))
