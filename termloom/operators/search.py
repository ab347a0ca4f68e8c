"""Full-text search: positional postings, query grammar, set algebra and BM25 ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75

# Letters with diacritics and what they fold to.
_FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, without diacritics."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _fold(s: str) -> str:
    return s.lower().translate(str.maketrans(_FOLD_FROM, _FOLD_TO))


def postings(df: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(token, id, field, pos): one row for each occurrence; arrays are searched as the text of their elements."""
    fields = []
    for k, c in enumerate(columns):
        text = F.array_join(F.col(c), " ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
        fields.append(F.struct(F.lit(k).alias("field"), tokens(F.coalesce(text, F.lit(""))).alias("t")))
    each = df.select(F.col(id_).alias("id"), F.explode(F.array(*fields)).alias("f"))
    return each.select("id", F.col("f.field").alias("field"), F.posexplode("f.t").alias("pos", "token")).select("token", "id", "field", "pos")


@dataclass(frozen=True)
class Index:
    """Postings with the length dl of each one's document, how many documents have any, and their mean length."""

    postings: DataFrame
    n: int
    mean: float


def indexed(rows: DataFrame) -> Index:
    """An index over postings; lengths and figures come from one pass, two numbers of it reach the driver."""
    lengths = rows.groupBy("id").agg(F.count("*").alias("dl"))
    one = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    return Index(rows.join(lengths, "id"), one.n, one.mean or 1.0)


def write_index(rows: DataFrame, uri: str, mode: str = "error") -> Index:
    """Writes postings once, sorted by token, so that a search reads the row groups of its words alone."""
    made = indexed(rows)
    made.postings.repartitionByRange("token").sortWithinPartitions("token", "id").write.mode(mode).parquet(f"{uri}/postings")
    rows.sparkSession.createDataFrame([(made.n, made.mean)], "n long, mean double").coalesce(1).write.mode(mode).parquet(f"{uri}/figures")
    return read_index(rows.sparkSession, uri)


def read_index(spark: SparkSession, uri: str) -> Index:
    one = spark.read.parquet(f"{uri}/figures").first()
    return Index(spark.read.parquet(f"{uri}/postings"), one.n, one.mean)


def _rows(index: DataFrame | Index) -> DataFrame:
    return index.postings if isinstance(index, Index) else index


def concept_postings(concepts: DataFrame) -> DataFrame:
    """The postings of concept records: id, preferred term, synonyms and name."""
    return postings(concepts, "id", ["id", "preferred_term", "synonyms", "fsn"])


# --- queries ------------------------------------------------------------------


def sanitised(query: str, mode: str = "cli") -> str:
    """What a surface makes of what is typed, before it is parsed.

    cli: operators and special characters pass, anything else is one phrase.
    mcp: one plain word passes, anything else is one phrase, operators too.
    ui: operators (in capitals) and special characters pass, several words are
    a phrase, one word is a prefix.
    """
    if mode == "cli":
        if any(c in query for c in '"*^') or any(op in query.lower() for op in (" and ", " or ", " not ")):
            return query
        return '"' + query + '"'
    q = query.strip()
    if mode == "mcp":
        if not q:
            return ""
        return q if len(q.split()) == 1 and '"' not in q else '"' + q.replace('"', '""') + '"'
    if mode != "ui":
        raise ValueError(f"unknown mode {mode!r}")
    if " OR " in q or " AND " in q or "*" in q or '"' in q:
        return q
    if not q:
        return ""
    return f'"{q}"' if len(q.split()) > 1 else f"{q}*"


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    kind: str  # and, or, not
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|(\()|(\))|([^\s()"]+))')


def parse(query: str):
    """Phrases, prefixes (word*), NOT before AND before OR, parentheses; words side by side are joined by AND."""
    items: list[tuple[str, object]] = []
    at = 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if m is None:
            raise ValueError(f"the query can't be read from position {at}")
        at = m.end()
        if m[1] is not None:
            items.append(("term", _phrase(m[1].replace('""', '"'), bool(m[2]))))
        elif m[3]:
            items.append(("(", None))
        elif m[4]:
            items.append((")", None))
        elif m[5] in ("AND", "OR", "NOT"):
            items.append((m[5], None))
        else:
            items.append(("term", _phrase(m[5].rstrip("*").lstrip("^"), m[5].endswith("*"))))
    pos = 0

    def peek() -> str | None:
        return items[pos][0] if pos < len(items) else None

    def take():
        nonlocal pos
        pos += 1
        return items[pos - 1]

    def primary():
        kind, value = take() if pos < len(items) else (None, None)
        if kind == "term":
            return value
        if kind == "(":
            inner = either()
            if take()[0] != ")":
                raise ValueError("a parenthesis isn't closed")
            return inner
        raise ValueError("a search term is missing")

    def minus():
        left = primary()
        while peek() == "NOT":
            take()
            left = Both("not", left, primary())
        return left

    def every():
        left = minus()
        while peek() in ("AND", "term", "("):
            if peek() == "AND":
                take()
            left = Both("and", left, minus())
        return left

    def either():
        left = every()
        while peek() == "OR":
            take()
            left = Both("or", left, every())
        return left

    if not items:
        raise ValueError("the query is empty")
    tree = either()
    if pos < len(items):
        raise ValueError("the query goes on after its end")
    return tree


def _phrase(text: str, prefix: bool) -> Phrase:
    return Phrase(tuple(re.findall(r"[^\W_]+", _fold(text))), prefix)


def matches(index: DataFrame | Index, query) -> DataFrame:
    """(id): what a parsed query, or its text, matches. A phrase is a join of positions within a field."""
    index = _rows(index)
    q = parse(query) if isinstance(query, str) else query
    if isinstance(q, Both):
        a, b = matches(index, q.left), matches(index, q.right)
        if q.kind == "or":
            return a.unionAll(b).distinct()
        return a.join(b, "id", "left_semi" if q.kind == "and" else "left_anti")
    if not q.words:
        return index.select("id").limit(0)
    last = len(q.words) - 1
    out = None
    for k, w in enumerate(q.words):
        hit = F.col("token").startswith(w) if k == last and q.prefix else F.col("token") == w
        at = index.where(hit).select("id", "field", (F.col("pos") - k).alias("start"))
        out = at if out is None else out.join(at.distinct(), ["id", "field", "start"], "left_semi")
    return out.select("id").distinct()


def words_of(query) -> list[tuple[str, bool]]:
    """(word, prefix) of the parts of a query that a match contains."""
    q = parse(query) if isinstance(query, str) else query
    if isinstance(q, Both):
        return words_of(q.left) + (words_of(q.right) if q.kind != "not" else [])
    return [(w, q.prefix and k == len(q.words) - 1) for k, w in enumerate(q.words)]


def bm25(index: DataFrame | Index, query, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of what a query matches, by Okapi BM25 over all fields together.

    Only postings of the query's words are read: they bring their documents'
    lengths along, and the two figures of the whole index are numbers.
    """
    index = index if isinstance(index, Index) else indexed(index)
    q = parse(query) if isinstance(query, str) else query
    hit = matches(index, q)
    wanted = [(F.col("token").startswith(w) if p else F.col("token") == w, F.lit(k)) for k, (w, p) in enumerate(dict.fromkeys(words_of(q)))]
    if not wanted:
        return hit.withColumn("score", F.lit(0.0))
    any_ = reduce(Column.__or__, [c for c, _ in wanted])
    each = index.postings.where(any_).select("id", "dl", F.explode(F.array_compact(F.array(*[F.when(c, k) for c, k in wanted]))).alias("term"))
    tf = each.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    tf = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
    # of a query of words joined by OR every document with a posting is a hit
    full = tf if _all_of(q) else tf.join(hit, "id", "left_semi")
    idf = F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / index.mean))
    return full.groupBy("id").agg(F.sum(w).alias("score"))


def _all_of(q) -> bool:
    if isinstance(q, Both):
        return q.kind == "or" and _all_of(q.left) and _all_of(q.right)
    return len(q.words) == 1


def ranked(index: DataFrame | Index, query, limit: int = 10) -> DataFrame:
    """(id, score) of the best matches, ties by id."""
    return bm25(index, query).orderBy(F.col("score").desc(), "id").limit(limit)


def search(concepts: DataFrame, index: DataFrame | Index, query: str, limit: int | None = 10, most: int | None = 100, mode: str = "cli", hierarchy: str | None = None) -> DataFrame:
    """Concepts that match, best first; a hierarchy filters before the limit."""
    q = sanitised(query, mode)
    cols = ["id", "preferred_term", "fsn", "hierarchy"]
    if not q:
        return concepts.select(*cols, F.lit(0.0).alias("score")).limit(0)
    c = concepts if hierarchy is None else concepts.where(F.col("hierarchy") == hierarchy)
    out = c.select(*cols).join(bm25(index, q), "id").orderBy(F.col("score").desc(), "id")
    return out if limit is None or limit < 0 else out.limit(limit if most is None else min(limit, most))


def search_many(index: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(query_id, id, n): documents with all distinct words of each query (query_id, text), as one join of tokens."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    need = q.groupBy("query_id").agg(F.count("*").alias("need"))
    found = q.join(_rows(index).select("token", "id").distinct(), "token").groupBy("query_id", "id").agg(F.count("*").alias("n"))
    return found.join(need, "query_id").where("n = need").select("query_id", "id", "n")
