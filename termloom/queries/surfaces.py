"""Queries over what stands around the records: search surfaces, files of code lists, catalogues, exports, embeddings, emitted SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import scalars as fn
from ..operators import codelists as C
from ..operators import compare as D
from ..operators import search as S
from ..operators import sinks as K
from ..operators import vectors as V
from ..plans import artefacts
from ..sources import catalogue, records

from .terminology import _TOKENS, Terminology, _list_lines, _list_sql, _parts, _releases, _RELEASES, query

#: What is typed, and what it comes to on each surface.
_TYPED = ("of the", "ere", "ere*", "with AND from", "with OR keit")
_PHRASE = "SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = '{}' AND b.token = '{}'"
_PHRASE3 = "SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1 JOIN tok c ON a.id = c.id AND c.pos = a.pos + 2 WHERE a.token = '{}' AND b.token = '{}' AND c.token = '{}'"
_WORD, _START = "SELECT DISTINCT id FROM tok WHERE token = '{}'", "SELECT DISTINCT id FROM tok WHERE starts_with(token, '{}')"
_BOTH, _EITHER = "SELECT id FROM tok WHERE token = '{}' INTERSECT SELECT id FROM tok WHERE token = '{}'", "SELECT id FROM tok WHERE token = '{}' UNION SELECT id FROM tok WHERE token = '{}'"
_MEANT = {
    "cli": (_PHRASE.format("of", "the"), _WORD.format("ere"), _START.format("ere"), _BOTH.format("with", "from"), _EITHER.format("with", "keit")),
    "mcp": (_PHRASE.format("of", "the"), _WORD.format("ere"), _START.format("ere"), _PHRASE3.format("with", "and", "from"), _PHRASE3.format("with", "or", "keit")),
    "ui": (_PHRASE.format("of", "the"), _START.format("ere"), _START.format("ere"), _BOTH.format("with", "from"), _EITHER.format("with", "keit")),
}


@query(_TOKENS + " UNION ALL ".join(f"SELECT '{m}' AS surface, '{t}' AS typed, id FROM ({s})" for m, found in _MEANT.items() for t, s in zip(_TYPED, found)), base=False)
def search_surfaces(t, table):
    """What five typed queries match on each of three surfaces."""
    one = lambda m, q: S.matches(table.index(), S.sanitised(q, m)).select(F.lit(m).alias("surface"), F.lit(q).alias("typed"), "id")
    return reduce(DataFrame.unionAll, [one(m, q) for m in _MEANT for q in _TYPED])


@query("SELECT DISTINCT l_suppkey % 3 AS kind, CASE l_suppkey % 3 WHEN 0 THEN 'finding_site' WHEN 1 THEN 'associated_morphology' ELSE '900002' END AS label FROM lineitem", base=False)
def attribute_labels(t, table):
    kind = F.col("l_suppkey") % 3
    type_id = F.when(kind == 0, "363698007").when(kind == 1, "116676008").otherwise("900002")
    return table("lineitem").select(kind.alias("kind"), fn.attribute_label(type_id).alias("label")).distinct()


@query("SELECT page_id, trim(regexp_replace(lower(regexp_replace(list_extract(string_split(regexp_replace(u, '/+$', ''), '/'), -1), '\\.(zip|ZIP)$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '.zip' WHEN page_id % 3 = 1 THEN '//' ELSE '' END AS u FROM pages)", base=False)
def path_slugs(t, table):
    u = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".zip").when(F.col("page_id") % 3 == 1, "//").otherwise(""))
    return table("pages").select("page_id", fn.path_slugs(u).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders", base=False)
def dates_in_names(t, table):
    """The date in a file's name; one of four names has eight digits that are no date."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("/d.20010101/edition"), k.cast("string"), F.lit("x_"), F.when(k % 4 == 3, "99999999").otherwise(F.date_format("o_orderdate", "yyyyMMdd")), F.lit("T120000Z.v2.txt"))
    name = F.when(k % 4 == 3, F.regexp_replace(name, "edition[0-9]+", "edition")).otherwise(F.regexp_replace(name, "edition[0-9]+", "edition"))
    return table("orders").select("o_orderkey", fn.dates_in_names(name).alias("date"))


@query("SELECT id, regexp_full_match(id, '[0-9]*') AS digits, regexp_full_match(id[2:], '[0-9]*') AS rest FROM concepts")
def digits_of(t: Terminology, _):
    return t.concepts.select("id", fn.all_digits(F.col("id")).alias("digits"), fn.all_digits(F.substring("id", F.lit(2), F.length("id"))).alias("rest"))


@query("SELECT conv_id, turn, 'search_query: ' || text AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''", base=False)
def query_texts(t, table):
    return table("conversations").where("trim(coalesce(text, '')) <> ''").select("conv_id", "turn", fn.query_texts(F.col("text")).alias("text"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, current_date) AS days FROM orders", base=False)
def release_age_today(t, table):
    return table("orders").select("o_orderkey", fn.release_age(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("long").alias("days"))


@query("SELECT c.id, p.id AS parent, p.fsn FROM concepts c JOIN isa ON child_id = c.id JOIN concepts p ON p.id = parent_id")
def json_parents(t: Terminology, _):
    """Parents out of the JSON text of the flat form."""
    x = F.explode(F.from_json("parents", "array<struct<id:string,fsn:string>>"))
    return K.flat(t.concepts).select("id", x.alias("p")).select("id", F.col("p.id").alias("parent"), "p.fsn")


# --- orders, listings, exports ---------------------------------------------------------


@query("SELECT id, row_number() OVER (ORDER BY id) AS place FROM concepts ORDER BY id LIMIT 500")
def ndjson_order(t: Terminology, _):
    """The first lines of the NDJSON form, with their places."""
    first = K.ndjson_lines(t.concepts).limit(500)
    return first.select(F.get_json_object("value", "$.id").alias("id"), (F.monotonically_increasing_id() + 1).alias("place"))


@query(_RELEASES + "SELECT change, id, row_number() OVER (ORDER BY CASE change WHEN 'added' THEN 0 WHEN 'inactivated' THEN 1 WHEN 'preferred_term_changed' THEN 2 ELSE 3 END, id) AS place FROM d QUALIFY place <= 400", base=False)
def release_diff_order(t, table):
    """The first changes in the order of a report, with their places."""
    return D.ordered(D.compare(*_releases(table))).limit(400).select("change", "id", (F.monotonically_increasing_id() + 1).alias("place"))


_HEADS = "CASE change WHEN 'added' THEN 'Added' WHEN 'inactivated' THEN 'Inactivated' WHEN 'preferred_term_changed' THEN 'Terms changed' ELSE 'Hierarchies changed' END"


@query(_RELEASES + f", r AS (SELECT *, CASE change WHEN 'added' THEN 0 WHEN 'inactivated' THEN 1 WHEN 'preferred_term_changed' THEN 2 ELSE 3 END AS k, row_number() OVER (PARTITION BY change ORDER BY id) AS n FROM d) SELECT k * 1000000 AS line_no, {_HEADS} || ': ' || count(*) AS line FROM r GROUP BY k, change UNION ALL SELECT k * 1000000 + n, '  ' || id || ' ' || preferred_term || coalesce(' (' || old_value || ' -> ' || new_value || ')', '') FROM r WHERE n <= 10", base=False)
def release_diff_report(t, table):
    return D.report(*_releases(table))


@query("SELECT id, '{' || chr(10) || '  \"id\" : \"' || id || '\",' || chr(10) || '  \"children_count\" : ' || children_count || chr(10) || '}' AS json FROM concepts")
def pretty_json(t: Terminology, _):
    c = t.concepts.select("id", "children_count")
    return K.pretty(c).select(F.get_json_object("json", "$.id").alias("id"), "json")


@query("SELECT event_id, event_type, props FROM events", base=False)
def csv_roundtrip(t, table):
    """Rows with quotes and commas, written as CSV and read again."""
    e = table("events").select("event_id", "event_type", "props")
    at = shared.folder(e.sparkSession, "csv")
    K.write_csv(e, at)
    return e.sparkSession.read.schema(e.schema).option("header", True).option("quote", '"').option("escape", '"').csv(at)


@query("SELECT 'total' AS name, count(*)::VARCHAR AS value FROM concepts UNION ALL SELECT 'inactive', count(*) FILTER (NOT active)::VARCHAR FROM concepts UNION ALL SELECT 'schema_version', '3' UNION ALL SELECT 'latest', max(effective_time) FROM concepts UNION ALL SELECT 'hierarchy: ' || hierarchy, count(*)::VARCHAR FROM concepts GROUP BY hierarchy")
def info_listing(t: Terminology, _):
    return artefacts.info(t.concepts)


@query("SELECT hierarchy, count(*) AS n, count(parent_id) AS n_edges FROM concepts LEFT JOIN isa ON child_id = id GROUP BY hierarchy")
def sql_views(t: Terminology, _):
    """SQL over the registered tables."""
    t.register()
    return t.concepts.sparkSession.sql("SELECT hierarchy, count(*) AS n, count(parent_id) AS n_edges FROM concepts LEFT JOIN concept_isa ON child_id = id GROUP BY hierarchy")


_SETS = {
    "below": ("descendants of N3 including self", "SELECT descendant_id AS id FROM closed WHERE ancestor_id = 'N3' UNION SELECT 'N3'"),
    "both": ("ancestors of C7 and ancestors of C8", "SELECT ancestor_id AS id FROM closed WHERE descendant_id = 'C7' INTERSECT SELECT ancestor_id FROM closed WHERE descendant_id = 'C8'"),
    "less": ("descendants of SEG:BUILDING excluding descendants of R1", "SELECT descendant_id AS id FROM closed WHERE ancestor_id = 'SEG:BUILDING' EXCEPT SELECT descendant_id FROM closed WHERE ancestor_id = 'R1'"),
    "where": ("descendants of PART where supplied_by is descendant of N3", "SELECT DISTINCT id FROM supplied WHERE target IN (SELECT descendant_id FROM closed WHERE ancestor_id = 'N3')"),
    "any": ('(children of "BR:Brand#11" where supplied_by is any) or members of SEG:BUILDING', "SELECT s.id FROM supplied s JOIN isa ON child_id = s.id WHERE parent_id = 'BR:Brand#11' UNION SELECT referenced_component_id FROM members WHERE refset_id = 'SEG:BUILDING'"),
    "name": ("children of AFRICA", "SELECT child_id AS id FROM isa JOIN concepts c ON c.id = parent_id WHERE preferred_term = 'AFRICA'"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, id FROM ({s})" for k, (_, s) in _SETS.items()))
def emitted_sql(t: Terminology, _):
    """Expressions as emitted SQL, names resolved, run over the registered tables."""
    t.closed  # noqa: B018  the closure is among the tables once it is made
    t.register()
    spark = t.concepts.sparkSession
    return reduce(DataFrame.unionAll, [spark.sql(t.sql(e)).select(F.lit(k).alias("name"), "id") for k, (e, _) in _SETS.items()])


@query("SELECT code FROM maps WHERE concept_id = 'P7'")
def translate_code(t: Terminology, _):
    return t.translate("P7", "ctv3")


# --- code lists as files ------------------------------------------------------------------


def _files(table) -> DataFrame:
    """The lists of _list_lines() and its shifted twin, written as two files and read again."""
    spark = table("part").sparkSession
    at = shared.folder(spark, "codelists")
    header = C.new("Parts list", "X CT", today="2024-01-01").split("\n---\n")[0].removeprefix("---\n")
    for k in (0, 1):
        doc = C.document(header, C.classified(_list_lines(table, k)).select("line_no", "kind", "code", "term", "comment"))
        doc.coalesce(1).write.text(f"{at}/.staged{k}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in fs.listStatus(path(f"{at}/.staged{k}")) if f.getPath().getName().startswith("part-"))
        fs.rename(part, path(f"{at}/list{k}.codelist"))
    return C.read(spark, at)


@query(f"SELECT 'list0' AS list, kind, code, term, comment FROM ({_list_sql()}) WHERE kind <> 'blank' UNION ALL SELECT 'list1', kind, code, CASE WHEN kind = 'active' THEN term ELSE term END, comment FROM ({_list_sql(1)}) WHERE kind <> 'blank'", base=False)
def codelist_files(t, table):
    """All lines but blank ones of code-list files below a folder."""
    rows = C.classified(C.lines(_files(table))).where("kind <> 'blank'")
    return rows.select(F.regexp_extract("file", r"(list\d)\.codelist$", 1).alias("list"), "kind", "code", "term", "comment")


@query("SELECT unnest(['list0', 'list1']) AS list, 'Parts list' AS title, 'X CT' AS terminology, 'draft' AS status, '2024-01-01' AS created, '1' AS version", base=False)
def codelist_headers(t, table):
    """The header of a new list, through a file and back."""
    field = lambda k: F.regexp_replace(F.regexp_extract("header", rf"(?m)^{k}:[ \t]*(.*)$", 1), "^'|'$", "").alias(k)
    return _files(table).where("error is null").select(F.regexp_extract("file", r"(list\d)\.codelist$", 1).alias("list"), *[field(k) for k in ("title", "terminology", "status", "created", "version")])


@query(f"WITH l AS ({_list_sql()}), f AS (SELECT min(line_no) AS first FROM l WHERE kind = 'active' AND code = '8') SELECT line_no, CASE WHEN line_no = first THEN 'excluded' ELSE kind END AS kind, code, term, CASE WHEN line_no = first THEN 'withdrawn' ELSE comment END AS comment FROM l, f", base=False)
def codelist_remove(t, table):
    return C.removed(C.classified(_list_lines(table)).select("line_no", "kind", "code", "term", "comment"), "8", "withdrawn")


@query(f", l AS ({_list_sql()}), c AS (SELECT id[2:] AS id, preferred_term FROM concepts WHERE id LIKE 'P%' AND id <> 'PART' AND active AND TRY_CAST(id[2:] AS BIGINT) % 19 <> 0) SELECT c.id AS code, preferred_term AS term FROM c JOIN isa ON child_id = 'P' || c.id WHERE parent_id = 'BR:Brand#11' AND c.id NOT IN (SELECT code FROM l WHERE kind = 'active')")
def codelist_add_below(t: Terminology, table):
    """What a brand's descendants add to a list."""
    parts = _parts(t)
    bare = F.when(F.col("child_id").rlike("^P[0-9]+$"), F.substring("child_id", F.lit(2), F.length("child_id"))).otherwise(F.col("child_id"))
    isa = t.isa.select(bare.alias("child_id"), "parent_id")
    return C.added(C.classified(_list_lines(table)), parts, parts.select("id").limit(0), isa, "BR:Brand#11")[0]


@query(f"SELECT line_no::INT AS line_no, code || ',' || term AS line FROM ({_list_sql()}) WHERE kind = 'active' UNION ALL SELECT -1, 'sctid,preferred_term'", base=False)
def codelist_export_csv(t, table):
    return C.exported(C.classified(_list_lines(table)), "csv")


@query(f"SELECT line_no::INT AS line_no, '| `' || code || '` | ' || term || ' |' AS line FROM ({_list_sql()}) WHERE kind = 'active'", base=False)
def codelist_export_markdown(t, table):
    """The rows of the Markdown table."""
    return C.exported(C.classified(_list_lines(table)), "markdown", {"title": "x"}).where("line_no > 0")


# --- catalogues and embeddings ----------------------------------------------------------------


@query("WITH c AS (SELECT o_orderpriority AS edition, o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders), l AS (SELECT edition, max(d) AS release_date FROM c GROUP BY 1), h AS (SELECT edition, max(d) AS mine FROM c WHERE o_orderkey % 50 = 0 AND edition <> '5-LOW' GROUP BY 1) SELECT l.edition, release_date FROM l LEFT JOIN h USING (edition) WHERE mine IS NULL OR release_date > mine", base=False)
def catalogue_newer(t, table):
    o = table("orders").select(F.col("o_orderpriority").alias("edition"), "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("release_date"))
    all_ = o.select("edition", F.concat("edition", F.lit(".zip")).alias("name"), "release_date", F.lit("u").alias("url"), F.lit("0").alias("sha256"))
    return catalogue.newer(all_, o.where("o_orderkey % 50 = 0 and edition <> '5-LOW'").select("edition", "release_date")).select("edition", "release_date")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query(f"SELECT 'P' || e.vec_id AS id, preferred_term, round({_COS}, 6) AS similarity FROM embeddings e JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1) v ON true JOIN concepts ON id = 'P' || e.vec_id WHERE e.label = 3 ORDER BY similarity DESC, id LIMIT 10")
def nearest_concepts(t: Terminology, table):
    """Concepts most like a vector within one label, with their terms."""
    e = table("embeddings")
    named = e.select(F.concat(F.lit("P"), F.col("vec_id").cast("string")).alias("id"), F.col("label").cast("string").alias("hierarchy"), "embedding").join(t.concepts.select("id", "preferred_term"), "id")
    v = list(e.where("vec_id = 1").first().embedding)
    return t.nearest(named, v, 10, hierarchy="3").select("id", "preferred_term", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT v.vec_id AS query_id, e.vec_id AS id, {_COS} AS s FROM embeddings e, q v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS n FROM s), t AS (SELECT * FROM r WHERE n <= 20),
b AS (SELECT query_id, min(n) FILTER (id = query_id + (query_id // 50) % 3) AS place, avg(s) AS m FROM t GROUP BY 1)
SELECT avg((coalesce(place, 99) <= 1)::INT::DOUBLE) AS top_1, avg((coalesce(place, 99) <= 5)::INT::DOUBLE) AS top_5, avg((coalesce(place, 99) <= 10)::INT::DOUBLE) AS top_10, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr, round(avg(m), 6) AS mean_similarity FROM b""",
    base=False,
)
def retrieval(t, table):
    """Figures of a search in which a third of the queries look for themselves."""
    e = table("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = V.nearest_many(e, q, 20, id_="vec_id").select("query_id", F.col("vec_id").alias("id"), "similarity")
    truth = q.select("query_id", (F.col("query_id") + F.floor(F.col("query_id") / 50) % 3).alias("id"))
    m = V.retrieval_figures(found, truth)
    return m.select("top_1", "top_5", "top_10", F.round("mrr", 6).alias("mrr"), F.round("mean_similarity", 6).alias("mean_similarity"))


@query("SELECT id, preferred_term, hierarchy, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b FROM (SELECT id, preferred_term, hierarchy, 'search_document: ' || preferred_term || '. ' || fsn || '. ' || CASE WHEN len(synonyms) > 0 THEN 'Synonyms: ' || array_to_string(synonyms, ', ') || '. ' ELSE '' END || 'Hierarchy: ' || array_to_string(hierarchy_path, ' > ') || '.' AS text FROM concepts)")
def embedded_concepts(t: Terminology, _):
    """Every concept's text through a model; this one counts characters and spaces."""
    e = V.embedded(t.concepts, lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts])
    return e.select("id", "preferred_term", "hierarchy", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


@query("SELECT vec_id::VARCHAR AS id, label::VARCHAR AS hierarchy, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings", base=False)
def arrow_roundtrip(t, table):
    """Embeddings through one Arrow file."""
    e = table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("x").alias("preferred_term"), F.col("label").cast("string").alias("hierarchy"), "embedding")
    spark = e.sparkSession
    at = shared.folder(spark, "embeddings").removeprefix("file://") + ".arrow"
    K.write_arrow(e, at)
    back = records.read_embeddings(spark, at, 64)
    return back.select("id", "hierarchy", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))
