"""What the operators share: the folder that the driver and every executor see, files in it, names, running sums.

The cluster names the folder in spark.checkpoint.dir; only where that is unset
(as in tests) is one set. Nothing that another machine needs is written to a
machine's own folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, folder, root, tidy

__all__ = ["Store", "as_row", "cut", "folder", "local_path", "quoted", "root", "running", "ship", "shuffled", "tidy"]


def local_path(uri: str) -> str | None:
    """The path of a file: URI that every machine mounts, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


class Store:
    """Files below a shared URI, from Python on any machine: plain files for file:, else Arrow's file systems."""

    def __init__(self, uri: str):
        self.uri = uri
        self.path = local_path(uri)

    def _fs(self):
        from pyarrow import fs

        if self.path is not None:
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, chunks) -> int:
        """Writes a file whole or not at all: under a name of its own first, then renamed. Returns its length."""
        fs, top = self._fs()
        fs.create_dir(top, recursive=True)
        part, n = f"{top}/.{name}.{uuid.uuid4().hex}", 0
        try:
            with fs.open_output_stream(part) as out:
                for x in chunks:
                    out.write(x)
                    n += len(x)
            fs.move(part, f"{top}/{name}")
        except BaseException:
            try:
                fs.delete_file(part)
            except OSError:
                pass
            raise
        return n

    def open(self, name: str):
        fs, top = self._fs()
        return fs.open_input_file(f"{top}/{name}")

    def stream(self, name: str):
        fs, top = self._fs()
        return fs.open_input_stream(f"{top}/{name}", compression=None)

    def delete(self, name: str) -> None:
        """Removes a file; one that is gone already is no error."""
        fs, top = self._fs()
        try:
            fs.delete_file(f"{top}/{name}")
        except FileNotFoundError:
            pass


def quoted(name: str) -> str:
    """A column's name as one that may hold dots and back quotes."""
    return "`" + name.replace("`", "``") + "`"


def as_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def shuffled(df: DataFrame) -> DataFrame:
    """A join's side with which both sides are shuffled and none goes through the driver.

    Spark takes a table that is exploded for no longer than before, and so
    would broadcast rows of many times the size that it allows.
    """
    return df.hint("merge")


def running(df: DataFrame, by: list[str], place: str, value: str, out: str, step: int = 1024) -> DataFrame:
    """Adds out: the sum of value over the rows of by with a smaller place (a number from 0, each once).

    In two levels, as a group may hold a third of all rows: sums over step
    places, then within these, so that a task sees a step's rows, or one row
    for each step.
    """
    own = df.withColumn("__step", F.expr(f"{place} div {step}"))
    steps = own.groupBy(*by, "__step").agg(F.sum(value).alias("__sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = steps.select(*by, "__step", F.coalesce(F.sum("__sum").over(before(Window.partitionBy(*by).orderBy("__step"))), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy(*by, "__step").orderBy(place))), F.lit(0))
    return own.join(shuffled(first), [*by, "__step"]).withColumn(out, F.col("__first") + inside).drop("__step", "__first")


_SHIPPED: set[str] = set()


ROWS_PER_BATCH = 2000  # of Arrow batches; documents are longer than the rows that Spark's default of 10,000 is for


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they need no copy on their path.

    Also sets the rows of an Arrow batch where the session has Spark's default.
    """
    import atexit
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS_PER_BATCH))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    own = tempfile.mkdtemp()  # the driver's; executors get the file from the driver, for as long as it runs
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    at = Path(own) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)
