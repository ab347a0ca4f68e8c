"""A small language for sets of concepts, and its translation to DataFrames and to expression constraint text.

    descendants of X | ancestors of X [including self] | children of X | parents of X | members of X | X
    <set> where <attribute> is Y | is descendant of Y | is any
    <set> and <set> | <set> or <set> | <set> excluding <set>, of equal precedence, from the left; parentheses

X is an id, a quoted term or the words of a term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Concept:
    name: str


@dataclass(frozen=True)
class Related:
    kind: str  # descendants, ancestors, children, parents, members
    of: Concept
    self: bool = False


@dataclass(frozen=True)
class Where:
    base: object
    attribute: str
    kind: str  # is, below, any
    value: Concept | None = None


@dataclass(frozen=True)
class Combined:
    kind: str  # and, or, excluding
    left: object
    right: object


_WORD = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')
_STOPS = {"and", "or", "excluding", "where", "including", ")", "("}
_KINDS = ("descendants", "ancestors", "children", "parents", "members")


class AmbiguousName(ValueError):
    """A term that several concepts have."""


def parse(text: str):
    items = []
    at = 0
    text = text.strip()
    while at < len(text):
        m = _WORD.match(text, at)
        if m is None:
            raise ValueError(f"the expression can't be read from position {at}")
        items.append((m[1], True) if m[1] is not None else (m[2] or m[3], False))
        at = m.end()
    pos = 0

    def word(k: int = 0) -> str | None:
        return items[pos + k][0].lower() if pos + k < len(items) and not items[pos + k][1] else None

    def skip(*expected: str) -> None:
        nonlocal pos
        for w in expected:
            if word() != w:
                raise ValueError(f"{w!r} is expected")
            pos += 1

    def concept() -> Concept:
        nonlocal pos
        if pos < len(items) and items[pos][1]:
            pos += 1
            return Concept(items[pos - 1][0])
        out = []
        while pos < len(items) and not items[pos][1] and items[pos][0].lower() not in _STOPS:
            out.append(items[pos][0])
            pos += 1
        if not out:
            raise ValueError("a concept is missing")
        return Concept(" ".join(out))

    def one():
        nonlocal pos
        if word() == "(":
            pos += 1
            inner = combined()
            skip(")")
            out = inner
        elif word() in _KINDS and word(1) == "of":
            kind = word()
            pos += 2
            of, own = concept(), False
            if word() == "including":
                skip("including", "self")
                own = True
            out = Related(kind, of, own)
        else:
            out = concept()
        while word() == "where":
            pos += 1
            attribute = []
            while word() is not None and word() != "is":
                attribute.append(items[pos][0])
                pos += 1
            skip("is")
            name = "_".join(attribute).lower()
            if word() == "any":
                pos += 1
                out = Where(out, name, "any")
            elif word() == "descendant":
                skip("descendant", "of")
                out = Where(out, name, "below", concept())
            else:
                out = Where(out, name, "is", concept())
        return out

    def combined():
        nonlocal pos
        left = one()
        while word() in ("and", "or", "excluding"):
            kind = word()
            pos += 1
            left = Combined(kind, left, one())
        return left

    tree = combined()
    if pos < len(items):
        raise ValueError("the expression goes on after its end")
    return tree


_SIGN = {("descendants", False): "<", ("descendants", True): "<<", ("ancestors", False): ">", ("ancestors", True): ">>", ("children", False): "<!", ("children", True): "<<!", ("parents", False): ">!", ("parents", True): ">>!", ("members", False): "^", ("members", True): "^"}


def constraint(tree) -> str:
    """The expression as constraint text."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Concept):
        return tree.name
    if isinstance(tree, Related):
        return f"{_SIGN[tree.kind, tree.self]} {tree.of.name}"
    if isinstance(tree, Where):
        value = "*" if tree.kind == "any" else (f"< {tree.value.name}" if tree.kind == "below" else tree.value.name)
        base = constraint(tree.base)
        return f"{f'({base})' if isinstance(tree.base, Combined) else base} : {tree.attribute} = {value}"
    sign = {"and": "AND", "or": "OR", "excluding": "MINUS"}[tree.kind]
    side = lambda x: f"({constraint(x)})" if isinstance(x, (Combined, Where)) else constraint(x)
    return f"{side(tree.left)} {sign} {side(tree.right)}"


def sql(tree, resolve) -> str:
    """The expression as SQL over the registered tables concepts, concept_isa, concept_ancestors and refset_members.

    resolve gives the id of a Concept. Descendants and ancestors go by the
    closure, so that no statement needs recursion.
    """
    if isinstance(tree, str):
        tree = parse(tree)
    text = lambda x: "'" + x.replace("'", "''") + "'"
    if isinstance(tree, Concept):
        return f"SELECT id FROM concepts WHERE id = {text(resolve(tree))}"
    if isinstance(tree, Related):
        i = text(resolve(tree.of))
        table, get, by = {
            "descendants": ("concept_ancestors", "descendant_id", "depth > 0 AND ancestor_id"), "ancestors": ("concept_ancestors", "ancestor_id", "depth > 0 AND descendant_id"),
            "children": ("concept_isa", "child_id", "parent_id"), "parents": ("concept_isa", "parent_id", "child_id"), "members": ("refset_members", "referenced_component_id", "refset_id"),
        }[tree.kind]
        out = f"SELECT DISTINCT {get} AS id FROM {table} WHERE {by} = {i}"
        return f"{out} UNION SELECT id FROM concepts WHERE id = {i}" if tree.self else out
    if isinstance(tree, Where):
        has = f"SELECT id, explode(attributes[{text(tree.attribute)}].id) AS target FROM concepts WHERE id IN ({sql(tree.base, resolve)})"
        if tree.kind == "any":
            return f"SELECT DISTINCT id FROM ({has})"
        i = text(resolve(tree.value))
        among = f"= {i}" if tree.kind == "is" else f"IN (SELECT descendant_id FROM concept_ancestors WHERE depth > 0 AND ancestor_id = {i})"
        return f"SELECT DISTINCT id FROM ({has}) WHERE target {among}"
    word = {"and": "INTERSECT", "or": "UNION", "excluding": "EXCEPT"}[tree.kind]
    return f"SELECT id FROM ({sql(tree.left, resolve)}) {word} SELECT id FROM ({sql(tree.right, resolve)})"


class Resolver:
    """Ids of names: an id as it is, else the one concept with that term."""

    def __init__(self, concepts: DataFrame):
        self.concepts = concepts

    def __call__(self, c: Concept) -> str:
        by_id = self.concepts.where(F.col("id") == c.name).select("id")
        if c.name.isdigit() or not by_id.isEmpty():
            return c.name
        found = [r.id for r in self.concepts.where(F.lower("preferred_term") == c.name.lower()).select("id").orderBy("id").limit(6).collect()]
        if not found:
            raise LookupError(f"no concept is called {c.name!r}")
        if len(found) > 1:
            raise AmbiguousName(f"{c.name!r} may be {', '.join(found[:5])}{' and more' if len(found) > 5 else ''}")
        return found[0]


def evaluate(tree, concepts: DataFrame, isa: DataFrame, closed: DataFrame, members: DataFrame | None = None, resolve=None) -> DataFrame:
    """(id): the set that an expression, or its text, describes. closed is a closure without, or with, selves."""
    if isinstance(tree, str):
        tree = parse(tree)
    resolve = resolve or Resolver(concepts)
    rest = (concepts, isa, closed, members, resolve)
    own = lambda i: concepts.where(F.col("id") == i).select("id")
    if isinstance(tree, Concept):
        return own(resolve(tree))
    if isinstance(tree, Related):
        i = resolve(tree.of)
        if tree.kind == "descendants":
            out = closed.where((F.col("ancestor_id") == i) & (F.col("depth") > 0)).select(F.col("descendant_id").alias("id"))
        elif tree.kind == "ancestors":
            out = closed.where((F.col("descendant_id") == i) & (F.col("depth") > 0)).select(F.col("ancestor_id").alias("id"))
        elif tree.kind == "children":
            out = isa.where(F.col("parent_id") == i).select(F.col("child_id").alias("id"))
        elif tree.kind == "parents":
            out = isa.where(F.col("child_id") == i).select(F.col("parent_id").alias("id"))
        else:
            if members is None:
                raise ValueError("there are no refset members")
            out = members.where(F.col("refset_id") == i).select(F.col("referenced_component_id").alias("id"))
        return (out.unionAll(own(i)) if tree.self else out).distinct()
    if isinstance(tree, Where):
        has = concepts.join(evaluate(tree.base, *rest), "id", "left_semi").select("id", F.col("attributes")[tree.attribute].alias("refs")).where("refs is not null")
        if tree.kind == "any":
            return has.select("id")
        each = has.select("id", F.explode("refs.id").alias("target"))
        i = resolve(tree.value)
        if tree.kind == "is":
            return each.where(F.col("target") == i).select("id").distinct()
        low = closed.where((F.col("ancestor_id") == i) & (F.col("depth") > 0)).select(F.col("descendant_id").alias("target"))
        return each.join(low, "target", "left_semi").select("id").distinct()
    a, b = evaluate(tree.left, *rest), evaluate(tree.right, *rest)
    if tree.kind == "or":
        return a.unionAll(b).distinct()
    return a.join(b, "id", "left_semi" if tree.kind == "and" else "left_anti").distinct()
