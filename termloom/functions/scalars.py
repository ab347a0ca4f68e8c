"""Scalar functions as Column expressions, and the few that only ever run on the driver."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ATTRIBUTE_LABELS


def strip_tag(fsn: Column) -> Column:
    """A fully specified name without what follows its last " ("."""
    return F.regexp_replace(fsn, r"(?s) \((?!.* \().*$", "")


def semantic_tag(fsn: Column) -> Column:
    """What stands between the last " (" and a closing parenthesis at the end; else empty."""
    return F.regexp_extract(fsn, r"(?s) \(((?:(?! \().)*)\)$", 1)


def attribute_label(type_id: Column) -> Column:
    """The label of an attribute type, or its id."""
    pairs = [F.lit(x) for kv in ATTRIBUTE_LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[type_id], type_id)


def slug(s: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def path_slug(path: str) -> str:
    """The slug of a path's last part, less .zip; runs on the driver."""
    name = PurePath(path.rstrip("/")).name
    return re.sub("[^a-z0-9]+", "-", re.sub(r"\.(zip|ZIP)$", "", name).lower()).strip("-")


def path_slugs(path: Column) -> Column:
    """path_slug() of a column."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return slug(F.regexp_replace(name, r"\.(zip|ZIP)$", ""))


def title_case(s: Column) -> Column:
    """The first letter upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def human_size(n: Column, kb_digits: int = 1, gigabytes: bool = True) -> Column:
    """Bytes as B, KB, MB or GB, one decimal (KB: kb_digits); without gigabytes, MB is the largest unit."""
    x = n.cast("double")
    # a division by a power of two is exact, so that halves can be rounded to even, as binary formatting does
    of = lambda unit, name, digits=1: F.format_string(f"%.{digits}f {name}", F.bround(x / unit, digits))
    return F.when((n >= 1 << 30) & F.lit(gigabytes), of(1 << 30, "GB")).when(n >= 1 << 20, of(1 << 20, "MB")).when(n >= 1 << 10, of(1 << 10, "KB", kb_digits)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def thousands(n: Column) -> Column:
    """An integer with commas."""
    return F.format_number(n, 0)


def csv_field(s: Column) -> Column:
    """Quoted, with quotes doubled, if it holds a comma, a quote or a line end."""
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def padded(s: Column, width: int) -> Column:
    """Spaces on the right up to width; longer strings stay whole."""
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(s, width, " "))


def all_digits(s: Column) -> Column:
    return s.rlike("^[0-9]*$")


def date_in_name(path: str) -> str | None:
    """The first run of eight digits in a file's stem that reads as a date, as YYYY-MM-DD; runs on the driver."""
    stem = PurePath(path).stem
    for m in re.finditer(r"(?=(\d{4})(\d{2})(\d{2}))", stem, re.ASCII):
        y, mo, d = map(int, m.groups())
        if 1900 <= y <= 2100 and 1 <= mo <= 12 and 1 <= d <= 31:
            return "-".join(m.groups())
    return None


def dates_in_names(path: Column) -> Column:
    """date_in_name() of a column."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    found = F.regexp_extract(stem, r"((?:19\d\d|20\d\d|2100)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))", 1)
    return F.when(found != "", F.concat_ws("-", F.substring(found, 1, 4), F.substring(found, 5, 2), F.substring(found, 7, 2)))


def query_texts(query: Column) -> Column:
    """query_text() of a column; an empty query is an error while it is read."""
    return F.when(F.trim(query) == "", F.raise_error(F.lit("the query is empty")).cast("string")).otherwise(F.concat(F.lit("search_query: "), query))


def release_age(release: Column, today: Column | None = None) -> Column:
    """Days since a release date written as YYYYMMDD or YYYY-MM-DD; null if it is neither."""
    at = F.coalesce(F.try_to_date(release, "yyyyMMdd"), F.try_to_date(release, "yyyy-MM-dd"))
    return F.datediff(today if today is not None else F.current_date(), at)


def checksum(content: Column) -> Column:
    """SHA-256 as upper-case hex."""
    return F.upper(F.sha2(content, 256))


_TOKEN = re.compile(r"\{([^}]*)\}")
LINE, FSN_SUFFIX = "{id} | {pt} ({hierarchy})", " - FSN: {fsn}"


def _filled(template: str, fields: dict[str, Column]) -> Column:
    parts: list[Column] = []
    at = 0
    for m in _TOKEN.finditer(template):
        parts += [F.lit(template[at : m.start()]), fields.get(m[1], F.lit(m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def rendered(row: dict[str, Column], line: str = LINE, suffix: str = FSN_SUFFIX) -> Column:
    """A concept line by template, compiled once to an expression.

    row may have id, pt, fsn, hierarchy, module, effective_time, count and
    score; what is missing or null renders empty, names that aren't known stay
    as they are, braces included. The suffix follows only if the stripped FSN
    isn't empty-named and differs from pt.
    """
    text = lambda k: F.coalesce(row[k].cast("string"), F.lit("")) if k in row else F.lit("")
    raw = text("fsn")
    score = F.coalesce(F.format_string("%.4f", row["score"].cast("double")), F.lit("")) if "score" in row else F.lit("")
    if "score" in row:
        score = F.when(row["score"].isNull(), F.lit("")).otherwise(score)
    known = {k: text(k) for k in ("id", "pt", "hierarchy", "module", "effective_time", "count")}
    known |= {"fsn": strip_tag(raw), "fsn_raw": raw, "tag": semantic_tag(raw), "score": score}
    out = _filled(line, known)
    if not suffix:
        return out
    return F.concat(out, F.when((raw != "") & (known["fsn"] != known["pt"]), _filled(suffix, known)).otherwise(F.lit("")))


def embed_text(c: str = "") -> Column:
    """The text that is embedded for a concept record."""
    col = lambda k: F.col(f"{c}{k}")
    names = F.when(F.size(col("synonyms")) > 0, F.concat(F.lit("Synonyms: "), F.array_join(col("synonyms"), ", "), F.lit(". "))).otherwise(F.lit(""))
    return F.concat(F.lit("search_document: "), col("preferred_term"), F.lit(". "), col("fsn"), F.lit(". "), names, F.lit("Hierarchy: "), F.array_join(col("hierarchy_path"), " > "), F.lit("."))


def query_text(query: str) -> str:
    """The text that is embedded for a query; an empty one is an error."""
    if not query.strip():
        raise ValueError("the query is empty")
    return f"search_query: {query}"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine likeness; 0 where the product of the norms is under 1e-9."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-9, F.lit(0.0)).otherwise(dot(a, b) / n)
