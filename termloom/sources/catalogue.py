"""Release catalogues as DataFrames: what there is, what is newer, whether a file is what it should be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import checksum

SCHEMA = "edition string, name string, release_date string, url string, sha256 string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue from JSON lines that were fetched by other means."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def latest(catalogue: DataFrame) -> DataFrame:
    """The newest release of each edition."""
    cols = [c for c in catalogue.columns if c != "edition"]
    return catalogue.groupBy("edition").agg(F.max_by(F.struct(*cols), "release_date").alias("r")).select("edition", *[F.col("r").getField(c).alias(c) for c in cols])


def newer(catalogue: DataFrame, have: DataFrame) -> DataFrame:
    """Latest releases of editions that have (edition, release_date) lacks or has older."""
    mine = have.groupBy("edition").agg(F.max("release_date").alias("mine"))
    return latest(catalogue).join(mine, "edition", "left").where("mine is null or release_date > mine").drop("mine")


def verified(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """(name, good): whether each file below folder has the catalogue's checksum, whatever the case of its letters."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), checksum(F.col("content")).alias("sum"))
    return files.join(catalogue.select("name", "sha256"), "name").select("name", (F.col("sum") == F.upper("sha256")).alias("good"))
