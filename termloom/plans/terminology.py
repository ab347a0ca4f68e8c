"""The library's front: one object over a terminology's tables, whose methods return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import build as B
from ..operators import hierarchy as H
from ..operators import lookup as L
from ..operators import search as S
from ..operators import vectors as V
from ..sources import records as R
from ..sources import release
from . import expressions as E


class Terminology:
    """Concept records with the tables derived from them; the closure and the index are made when first asked for."""

    def __init__(self, concepts: DataFrame, isa: DataFrame | None = None, maps: DataFrame | None = None, members: DataFrame | None = None, closed: DataFrame | None = None):
        self.concepts = concepts
        self.isa = isa if isa is not None else B.edges_of(concepts)
        self.maps = maps if maps is not None else B.maps_of(concepts)
        self.members = members if members is not None else B.members_of(concepts)
        self._closed, self._index = closed, None

    @classmethod
    def from_release(cls, spark: SparkSession, folders: list[str], **options) -> Terminology:
        return cls(B.build(release.read_release(spark, folders), **options))

    @classmethod
    def from_ndjson(cls, spark: SparkSession, path: str) -> Terminology:
        return cls(R.read_ndjson(spark, path))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Terminology:
        return cls(R.read_parquet(spark, path))

    @property
    def closed(self) -> DataFrame:
        """The closure, written to the shared folder, sorted by ancestor, when it is first asked for."""
        if self._closed is None:
            spark = self.concepts.sparkSession
            at = shared.folder(spark, "closure")
            H.closure(self.isa, self.concepts).repartitionByRange("ancestor_id", "descendant_id").sortWithinPartitions("ancestor_id", "descendant_id").write.parquet(at)
            self._closed = spark.read.parquet(at)
        return self._closed

    @property
    def index(self) -> S.Index:
        """The positional index, written to the shared folder when it is first asked for."""
        if self._index is None:
            self._index = S.write_index(S.concept_postings(self.concepts), shared.folder(self.concepts.sparkSession, "index"))
        return self._index

    def register(self) -> None:
        """Makes concepts, concept_isa, concept_maps, refset_members and, once made, concept_ancestors available to spark.sql()."""
        made = {"concept_ancestors": self._closed} if self._closed is not None else {}
        R.register(self.concepts.sparkSession, {"concepts": self.concepts, "concept_isa": self.isa, "concept_maps": self.maps, "refset_members": self.members} | made)

    def concept(self, code: str) -> DataFrame:
        return L.by_code(self.concepts, self.maps, code)

    def record(self, id_: str) -> DataFrame:
        return L.full_record(self.concepts, self.members, id_)

    def lookup(self, ids: DataFrame) -> DataFrame:
        return L.by_ids(self.concepts, ids)

    def children(self, id_: str, limit: int | None = 50) -> DataFrame:
        return H.children(self.concepts, self.isa, id_, limit)

    def parents(self, id_: str) -> DataFrame:
        return H.parents(self.concepts, self.isa, id_)

    def ancestors(self, id_: str) -> DataFrame:
        """Read off the closure if it has been made."""
        return H.ancestors(self.concepts, self.isa, id_, self._closed)

    def chain(self, id_: str) -> DataFrame:
        return H.chain(self.concepts, self.isa, id_, self._closed)

    def descendants(self, id_: str) -> DataFrame:
        return H.descendants(self.concepts, self.isa, id_, self._closed)

    def hierarchy(self, name: str, limit: int | None = 100) -> DataFrame:
        return L.in_hierarchy(self.concepts, name, limit)

    def is_a(self, pairs: DataFrame) -> DataFrame:
        return H.subsumes(pairs, self.closed)

    def search(self, query: str, limit: int | None = 10, mode: str = "cli", hierarchy: str | None = None) -> DataFrame:
        return S.search(self.concepts, self.index, query, limit, mode=mode, hierarchy=hierarchy)

    def nearest(self, embeddings: DataFrame, vector: list[float], limit: int | None = 10, **options) -> DataFrame:
        """Embedded concepts most like a vector, with their hierarchies."""
        return V.nearest(embeddings, vector, limit, **options)

    def select(self, expression: str) -> DataFrame:
        """Concepts that an expression of the set language describes."""
        return E.evaluate(expression, self.concepts, self.isa, self.closed, self.members)

    def sql(self, expression: str) -> str:
        """The SQL of an expression, over what register() makes available once there is a closure."""
        return E.sql(expression, E.Resolver(self.concepts))

    def map_to(self, code: str, terminology: str) -> DataFrame:
        return L.map_reverse(self.concepts, self.maps, code, terminology)

    def map_from(self, id_: str, terminology: str) -> DataFrame:
        return L.map_forward(self.maps, id_, terminology)

    def neighbourhood(self, id_: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        return H.neighbourhood(self.concepts, self.isa, id_, limit)

    # terminology-service operations over the same tables

    def validate_code(self, id_: str, display: str | None = None) -> DataFrame:
        """(result, display): whether the concept exists, is active and has the display text, if one is given."""
        one = L.by_id(self.concepts, id_).agg(F.max("preferred_term").alias("display"), F.max(F.col("active").cast("int")).alias("a"))
        good = F.coalesce(F.col("a") == 1, F.lit(False))
        return one.select((good & (F.col("display") == display) if display is not None else good).alias("result"), "display")

    def subsumption(self, a: str, b: str) -> DataFrame:
        """(outcome): equivalent, subsumes, subsumed-by or not-subsumed, of a to b."""
        if a == b:
            return self.concepts.sparkSession.createDataFrame([("equivalent",)], "outcome string")
        up = self.closed.where("depth > 0").where(((F.col("ancestor_id") == a) & (F.col("descendant_id") == b)) | ((F.col("ancestor_id") == b) & (F.col("descendant_id") == a)))
        return up.agg(F.max(F.when(F.col("ancestor_id") == a, "subsumes").otherwise("subsumed-by")).alias("o")).select(F.coalesce("o", F.lit("not-subsumed")).alias("outcome"))

    def subsumptions(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with outcome, of a to b."""
        low, high = H.subsumes(pairs, self.closed), H.subsumes(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct(), self.closed)
        both = low.join(high.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("subsumed").alias("above")), ["a", "b"])
        outcome = F.when(F.col("a") == F.col("b"), "equivalent").when(F.col("subsumed"), "subsumed-by").when(F.col("above"), "subsumes").otherwise("not-subsumed")
        return both.select("a", "b", outcome.alias("outcome"))

    def expand(self, expression: str, text: str | None = None, offset: int = 0, count: int | None = None) -> DataFrame:
        """A page of an expression's concepts by term, those that match a text if one is given."""
        c = self.concepts.join(self.select(expression), "id", "left_semi")
        if text is not None:
            c = c.join(S.matches(self.index, text), "id", "left_semi")
        return L.top(c.select("id", "preferred_term", "active"), ["preferred_term", "id"], count, None, offset)

    def translate(self, id_: str, terminology: str) -> DataFrame:
        return self.map_from(id_, terminology)
