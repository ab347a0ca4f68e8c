"""Release files: discovery, typed readers that keep file order, layers and archives."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..schema import RELEASE_FILES

# How the names of each kind of file begin.
PREFIXES = {
    "concept": ("sct2_Concept_",),
    "description": ("sct2_Description_",),
    "relationship": ("sct2_Relationship_",),
    "language_refset": ("der2_cRefset_Language",),
    "simple_map": ("der2_sRefset_SimpleMap",),
    "simple_refset": ("der2_Refset_Simple",),
}


def kind_of(name: str) -> str | None:
    """The kind of file that a name stands for; only Snapshot files count, and no stated relationships."""
    if "Snapshot" not in name or not name.endswith(".txt"):
        return None
    return next((k for k, starts in PREFIXES.items() if name.startswith(starts)), None)


def discover(folder: str, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """Snapshot files of each kind below a folder, sorted; links aren't followed.

    With a session the folder may be in any store that Spark reads, named by a
    URI. The listing is the driver's; the files are read by executors.
    """
    found: dict[str, list[str]] = {k: [] for k in PREFIXES}
    for path in _local(folder) if "://" not in folder and not folder.startswith("file:") else _stored(folder, spark or SparkSession.active()):
        if kind := kind_of(path.rsplit("/", 1)[-1]):
            found[kind].append(path)
    return {k: sorted(v) for k, v in found.items()}


def _local(folder: str) -> Iterable[str]:
    for top, _, names in os.walk(folder, onerror=lambda e: None, followlinks=False):
        yield from (p for name in names if not os.path.islink(p := os.path.join(top, name)))


def _stored(folder: str, spark: SparkSession) -> Iterable[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(conf).listFiles(at, True)
    while files.hasNext():
        yield files.next().getPath().toString()


def unpacked(path: str, staging: str) -> str:
    """A folder as it is; a .zip extracted below staging (members that would leave it are skipped), a single top folder unwrapped."""
    if not path.lower().endswith(".zip"):
        return path
    top = Path(staging, Path(path).stem).resolve()
    top.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path) as z:
        for m in z.infolist():
            to = (top / m.filename).resolve()
            if to != top and top not in to.parents:
                continue
            z.extract(m, top)
    inside = list(top.iterdir())
    return str(inside[0]) if len(inside) == 1 and inside[0].is_dir() else str(top)


def read_kind(spark: SparkSession, kind: str, paths: Iterable[str], quote: str = '"') -> DataFrame:
    """The rows of one kind of file, in all columns of the format, with active as boolean and ord.

    Columns are positional and the header is skipped; a ragged row is an error.
    ord orders rows as the files list them: the file's rank, the block, the
    place in the block. It is taken before any shuffle.
    """
    paths = list(paths)
    schema = RELEASE_FILES[kind]
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields])).withColumn("active", F.lit(True)).withColumn("ord", F.struct(F.lit(0).alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row")))
    raw = (
        spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).option("quote", quote).option("escape", quote)
        .option("mode", "FAILFAST").option("nullValue", "\x00").option("emptyValue", "").option("encoding", "UTF-8").csv(paths)
    )
    uris = [Path(os.path.abspath(p)).as_uri() if "://" not in p and not p.startswith("file:") else re.sub("^file:/+", "file:///", p) for p in paths]
    rank = F.create_map(*[F.lit(x) for i, u in enumerate(uris) for x in (u, i)])[F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")]
    ord_ = F.struct(F.coalesce(rank, F.lit(len(uris))).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    filled = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in schema.fields]
    return raw.select(*filled, ord_.alias("ord")).withColumn("active", F.col("active") == "1")


def read_release(spark: SparkSession, folders: Iterable[str], refsets: str = "simple", quote: str = '"', staging: str | None = None) -> dict[str, DataFrame]:
    """All kinds of files of one or several layered releases, in argument order.

    A release may be a .zip, which is extracted below staging (a folder that
    executors share; by default one in the shared folder). One without a
    concept file is an error, as a path that doesn't exist would otherwise read
    as an empty release. refsets: "simple" reads simple refsets, "none" leaves
    them out; "all" isn't supported.
    """
    if refsets not in ("none", "simple"):
        raise ValueError(f"refsets={refsets!r} is not supported")
    paths: dict[str, list[str]] = {k: [] for k in PREFIXES}
    for folder in folders:
        if folder.lower().endswith(".zip"):
            folder = unpacked(folder, staging or shared.folder(spark, "release").removeprefix("file://"))
        in_it = discover(folder, spark)
        if not in_it["concept"]:
            raise FileNotFoundError(f"there is no concept file below {folder}")
        for kind, found in in_it.items():
            paths[kind] += found
    if refsets == "none":
        paths["simple_refset"] = []
    out = {kind: read_kind(spark, kind, p, quote) for kind, p in paths.items()}
    out["simple_map"] = out["simple_map"].withColumn("map_target", F.trim("map_target")).where("map_target <> ''")
    return out
