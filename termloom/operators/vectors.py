"""Exact nearest neighbours by cosine, batch embedding with a pluggable model, and retrieval figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, embed_text, norm


def check_dimension(df: DataFrame, n: int, column: str = "embedding") -> DataFrame:
    """The rows, or an error while they are read if any vector has another length."""
    return df.where(F.assert_true(F.size(column) == n, F.lit(f"a vector doesn't have {n} dimensions")).isNull())


def nearest(df: DataFrame, query: list[float], k: int | None = 10, most: int | None = 100, id_: str = "id", column: str = "embedding", min_similarity: float | None = None, hierarchy: str | None = None) -> DataFrame:
    """The k rows most like a vector, exactly; ties by id; all rows if k is None. Filters come before the limit."""
    v = F.array(*[F.lit(float(x)) for x in query])
    d = df if hierarchy is None else df.where(F.col("hierarchy") == hierarchy)
    out = check_dimension(d, len(query), column).withColumn("similarity", cosine(F.col(column), v))
    if min_similarity is not None:
        out = out.where(F.col("similarity") >= min_similarity)
    out = out.drop(column).orderBy(F.col("similarity").desc(), id_)
    return out if k is None else out.limit(k if most is None else min(k, most))


def nearest_many(df: DataFrame, queries: DataFrame, k: int = 10, id_: str = "id", column: str = "embedding") -> DataFrame:
    """(query_id, id, similarity): the k rows most like each of many vectors (query_id and column), exactly; ties by id."""
    q = queries.select("query_id", F.col(column).alias("__v"))
    near = df.select(id_, column).crossJoin(q).select("query_id", id_, cosine(F.col(column), F.col("__v")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), id_)
    return near.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def embedded(concepts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, preferred_term, hierarchy, embedding): each concept's text through a model that is called on executors, batch texts at a time."""
    src = concepts.select("id", "preferred_term", "hierarchy", embed_text().alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, vectors = b.column(3).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = model(part)
                if len(got) != len(part):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(part)} texts")
                vectors += [[float(x) for x in v] for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(vectors, pa.list_(pa.float32()))], ["id", "preferred_term", "hierarchy", "embedding"])

    return src.mapInArrow(run, "id string, preferred_term string, hierarchy string, embedding array<float>")


def by_label(df: DataFrame, query: list[float], label: str, column: str = "embedding") -> DataFrame:
    """Mean and greatest likeness to a vector within each label."""
    s = df.select(label, cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("s"))
    return s.groupBy(label).agg(F.round(F.avg("s"), 6).alias("mean_similarity"), F.round(F.max("s"), 6).alias("max_similarity"), F.count("*").alias("n"))


def norms(df: DataFrame, id_: str, column: str = "embedding") -> DataFrame:
    return df.select(id_, norm(F.col(column)).alias("norm"))


def retrieval_figures(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Top-1, top-5, top-10, mean reciprocal rank and mean likeness of (query_id, id, similarity) against (query_id, id)."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    ranked = results.withColumn("rank", F.row_number().over(w)).join(truth.withColumn("right", F.lit(True)), ["query_id", "id"], "left")
    best = ranked.groupBy("query_id").agg(F.min(F.when(F.col("right"), F.col("rank"))).alias("at"), F.avg("similarity").alias("s"))
    best = truth.select("query_id").distinct().join(best, "query_id", "left")
    hit = lambda k: F.avg(F.when(F.col("at") <= k, 1.0).otherwise(0.0)).alias(f"top_{k}")
    return best.agg(hit(1), hit(5), hit(10), F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))).alias("mrr"), F.avg("s").alias("mean_similarity"))
