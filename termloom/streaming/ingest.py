"""Incremental ingestion: records that arrive in a folder keep a table of the latest record of each concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import CONCEPT
from ..sources.records import normalised


def stream_records(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Records of NDJSON files as they arrive in a folder."""
    return normalised(spark.readStream.schema(CONCEPT).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(folder))


BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The latest record of each id by effective_time; the arriving one wins a tie, of several of one batch that with the greatest hash."""
    both = new.withColumn("__new", F.lit(1))
    if old is not None:
        both = old.withColumn("__new", F.lit(0)).unionByName(both)
    cols = [c for c in new.columns if c != "id"]
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if new.schema[c].dataType.typeName() == "map" else F.col(c) for c in cols])
    return both.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("effective_time", "__new", tie)).alias("r")).select("id", *[F.col("r").getField(c).alias(c) for c in cols])


def keep_latest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges every batch into a table of BUCKETS ranges of ids' hashes, of which a batch writes those it has ids of.

    A bucket's versions are bucket=<b>/v=<batch>. A batch that runs again after
    a failure overwrites its own versions and reads those before: exactly once.
    Versions that are older than the one before a bucket's last are removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        arrived = batch.withColumn("bucket", _bucket())
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        before = _versions(spark, table, n - 1)
        old = _read(spark, table, {b: v for b, v in before.items() if b in touched})
        out = merged(old, batch).withColumn("bucket", _bucket()).withColumn("v", F.lit(n))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(table)
        _prune(spark, table, before)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """(bucket, version) of every folder of the table; the driver lists folders, no files are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{table}/bucket=*/v=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return [tuple(int(x.partition("=")[2]) for x in f.getPath().toString().rsplit("/", 2)[1:]) for f in found]


def _versions(spark: SparkSession, table: str, upto: int) -> dict[int, int]:
    """The last version of each bucket that no batch after upto has written."""
    out: dict[int, int] = {}
    for b, v in _listed(spark, table):
        if v <= upto:
            out[b] = max(v, out.get(b, 0))
    return out


def _read(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.schema(CONCEPT).parquet(*[f"{table}/bucket={b}/v={v}" for b, v in sorted(versions.items())])


def _prune(spark: SparkSession, table: str, keep: dict[int, int]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for b, v in _listed(spark, table):
        if v < keep.get(b, 0):
            at = path(f"{table}/bucket={b}/v={v}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, table: str, version: int) -> DataFrame:
    """The table as it is after a batch."""
    return _read(spark, table, _versions(spark, table, version)).select([f.name for f in CONCEPT.fields])


def counts_by_time(stream: DataFrame, time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows for each window of event time and kind, with late rows up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
