"""Readers of artefacts: concept records as NDJSON or Parquet, embeddings as Arrow IPC, release catalogues."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONCEPT

# Fields that every record of a file must have.
REQUIRED = ("id", "fsn", "preferred_term", "hierarchy", "children_count", "active", "module", "effective_time", "schema_version")


def normalised(df: DataFrame) -> DataFrame:
    """Concept records with empty strings, arrays and maps in place of nulls."""
    empty = {"StringType": F.lit(""), "ArrayType": F.array(), "MapType": F.create_map()}
    cols = []
    for f in CONCEPT.fields:
        e = empty.get(type(f.dataType).__name__)
        cols.append((F.coalesce(F.col(f.name), e.cast(f.dataType)) if e is not None else F.col(f.name)).alias(f.name))
    return df.select(*cols)


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Concept records, one JSON object a line; blank lines are skipped.

    A malformed line, or a record without one of the REQUIRED fields, is an
    error when it is read.
    """
    df = spark.read.schema(CONCEPT).option("mode", "FAILFAST").json(path)
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    whole = F.when(F.size(lacks) > 0, F.raise_error(F.concat(F.lit("record "), F.coalesce("id", F.lit("?")), F.lit(" lacks "), F.array_join(lacks, ", "))).cast("string")).otherwise(F.col("id"))
    return normalised(df.withColumn("id", whole))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Concept records from the native Parquet form, or from the one with JSON text in place of nested columns."""
    df = spark.read.parquet(path)
    for f in CONCEPT.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        elif isinstance(df.schema[f.name].dataType, T.StringType) and not isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}))
    return normalised(df.withColumn("schema_version", F.col("schema_version").cast("int")))


def read_embeddings(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """Embeddings from an Arrow IPC file that all machines see; missing columns or another dimension are errors.

    The driver reads the file's schema and how many batches it has; executors
    read the batches, each by its number.
    """
    import pyarrow as pa
    import pyarrow.ipc

    names = ["id", "preferred_term", "hierarchy", "embedding"]
    with pa.memory_map(path) as f:
        file = pyarrow.ipc.open_file(f)
        schema, n = file.schema, file.num_record_batches
    if missing := set(names) - set(schema.names):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    width = schema.field("embedding").type.list_size
    if dimension is not None and width != dimension:
        raise ValueError(f"the embeddings have {width} dimensions, the query has {dimension}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.ipc

        with pa.memory_map(path) as f:
            file = pyarrow.ipc.open_file(f)
            for b in batches:
                for k in b.column(0).to_pylist():
                    x = file.get_batch(k).select(names)
                    yield pa.RecordBatch.from_arrays([*x.columns[:3], x.column(3).cast(pa.list_(pa.float32()))], names)

    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "id string, preferred_term string, hierarchy string, embedding array<float>")


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Makes tables available to spark.sql() by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def check_version(records: DataFrame, supported: int = 3, margin: int = 5) -> str:
    """ "ok", "older", "newer" or "empty"; a version more than margin newer is an error."""
    v = records.agg(F.max("schema_version")).first()[0]
    if v is None:
        return "empty"
    if v > supported + margin:
        raise ValueError(f"schema version {v} is too new for {supported}")
    return "ok" if v == supported else "newer" if v > supported else "older"


def read_config(path: str) -> dict:
    """Settings from a TOML file; a missing or malformed one gives none."""
    try:
        return tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def resolve_path(explicit: str | None, default: str, env: str | None) -> str:
    """The first that exists of an explicit path, a default and one from the environment; an explicit one must exist."""
    if explicit is not None:
        if not Path(explicit).exists():
            raise FileNotFoundError(explicit)
        return explicit
    for p in (default, env):
        if p and Path(p).exists():
            return p
    raise FileNotFoundError(default)
