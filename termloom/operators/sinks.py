"""Writers of concept records and results: NDJSON, Parquet forms, relational tables, Arrow IPC, Markdown, CSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug, strip_tag, title_case
from .build import edges_of, maps_of, members_of


def ndjson_lines(records: DataFrame) -> DataFrame:
    """(value): one JSON object for each record, ordered by id over all partitions."""
    return records.orderBy("id").select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(records: DataFrame, path: str, mode: str = "error") -> None:
    """Files in id order; their names sort as their contents do."""
    ndjson_lines(records).write.mode(mode).text(path)


def flat(records: DataFrame) -> DataFrame:
    """The 13 columns of the Parquet form with JSON text in place of nested ones."""
    j = lambda c: F.to_json(c).alias(c)
    return records.select(
        "id", "fsn", "preferred_term", j("synonyms"), "hierarchy", j("hierarchy_path"), j("parents"), F.col("children_count").cast("long"), "active", "module", "effective_time", j("attributes"), F.col("schema_version").cast("long").alias("schema_version")
    )


def write_parquet(records: DataFrame, path: str, nested: bool = True, mode: str = "error") -> None:
    (records if nested else flat(records)).write.mode(mode).parquet(path)


def replaced(records: DataFrame, order: Column) -> DataFrame:
    """The last record of each id in order."""
    w = Window.partitionBy("id").orderBy(order.desc())
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tables(records: DataFrame) -> dict[str, DataFrame]:
    """concepts, concept_isa, concept_maps (first concept of a code) and refset_members."""
    maps = maps_of(records)
    return {
        "concepts": flat(records).join(records.select("id", F.to_json("ctv3_codes").alias("ctv3_codes"), F.to_json("read2_codes").alias("read2_codes")), "id"),
        "concept_isa": edges_of(records),
        "concept_maps": maps.groupBy("code", "terminology").agg(F.min("concept_id").alias("concept_id")),
        "refset_members": members_of(records),
    }


def write_tables(records: DataFrame, folder: str, mode: str = "error", buckets: int | None = None) -> None:
    """One Parquet table each below folder; edges and members sorted by the id they are looked up by."""
    for name, df in tables(records).items():
        key = {"concept_isa": "parent_id", "concept_maps": "code", "refset_members": "refset_id"}.get(name, "id")
        out = df.repartitionByRange(buckets, key) if buckets else df.repartitionByRange(key)
        out.sortWithinPartitions(key).write.mode(mode).parquet(f"{folder}/{name}")


def write_arrow(embeddings: DataFrame, path: str) -> int:
    """Embeddings as one Arrow IPC file with a fixed-size list, for readers that want one file; returns the rows.

    The file is written on the driver, a partition at a time.
    """
    import pyarrow as pa
    import pyarrow.ipc

    n, writer = 0, None
    width = embeddings.select(F.size("embedding")).first()
    if width is None:
        raise ValueError("there are no embeddings")
    schema = pa.schema([("id", pa.string()), ("preferred_term", pa.string()), ("hierarchy", pa.string()), ("embedding", pa.list_(pa.float32(), width[0]))])
    with pa.OSFile(path, "wb") as f:
        writer = pyarrow.ipc.new_file(f, schema)
        rows: list = []

        def flush() -> None:
            nonlocal rows, n
            if rows:
                writer.write_batch(pa.RecordBatch.from_pylist(rows, schema))
                n, rows = n + len(rows), []

        for r in embeddings.select(*schema.names).toLocalIterator():
            rows.append(r.asDict())
            if len(rows) >= 10_000:
                flush()
        flush()
        writer.close()
    return n


def markdown(c: str = "") -> Column:
    """The page of one concept."""
    col = lambda k: F.col(f"{c}{k}")
    path, n = col("hierarchy_path"), F.size(col("hierarchy_path"))
    crumb = F.when(n > 1, F.array_join(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), " > ")).otherwise(col("hierarchy"))
    listed = lambda items: F.array_join(items, "")
    synonyms = F.when(F.size(col("synonyms")) > 0, F.concat(F.lit("## Synonyms\n\n"), listed(F.transform(col("synonyms"), lambda s: F.concat(F.lit("- "), s, F.lit("\n")))), F.lit("\n"))).otherwise("")
    human = lambda k: title_case(F.replace(k, F.lit("_"), F.lit(" ")))
    relation = F.transform(F.map_entries(col("attributes")), lambda e: listed(F.transform(e["value"], lambda r: F.concat(F.lit("- **"), human(e["key"]), F.lit(":** "), strip_tag(r["fsn"]), F.lit(" ["), r["id"], F.lit("]\n")))))
    relations = F.when(F.size(col("attributes")) > 0, F.concat(F.lit("## Relationships\n\n"), listed(relation), F.lit("\n"))).otherwise("")
    tree = listed(F.transform(path, lambda label, i: F.concat(F.repeat(F.lit("  "), i), F.when(i == n - 1, F.concat(F.lit("- **"), label, F.lit("** *(this concept)*\n"))).otherwise(F.concat(F.lit("- "), label, F.lit("\n"))))))
    up = F.when(F.size(col("parents")) > 0, F.concat(F.lit("\n## Parents\n\n"), listed(F.transform(col("parents"), lambda p: F.concat(F.lit("- "), p["fsn"], F.lit(" `"), p["id"], F.lit("`\n")))))).otherwise("")
    return F.concat(F.lit("# "), col("preferred_term"), F.lit("\n\n**SCTID:** "), col("id"), F.lit("  \n**FSN:** "), col("fsn"), F.lit("  \n**Hierarchy:** "), crumb, F.lit("  \n\n"), synonyms, relations, F.lit("## Hierarchy\n\n"), tree, up)


def markdown_section(c: str = "") -> Column:
    """The section of one concept on its hierarchy's page."""
    col = lambda k: F.col(f"{c}{k}")
    names = F.when(F.size(col("synonyms")) > 0, F.concat(F.lit("**Synonyms:** "), F.array_join(col("synonyms"), ", "), F.lit("  \n"))).otherwise("")
    human = lambda k: title_case(F.replace(k, F.lit("_"), F.lit(" ")))
    relation = F.array_join(F.transform(F.map_entries(col("attributes")), lambda e: F.concat(F.lit("**"), human(e["key"]), F.lit(":** "), F.array_join(F.transform(e["value"], lambda r: strip_tag(r["fsn"])), ", "), F.lit("  \n"))), "")
    return F.concat(F.lit("---\n\n## "), col("preferred_term"), F.lit(" `"), col("id"), F.lit("`\n\n**FSN:** "), col("fsn"), F.lit("  \n"), names, relation, F.lit("\n"))


def write_markdown(records: DataFrame, folder: str) -> DataFrame:
    """A file for each concept, <hierarchy slug>/<id>.md (without a hierarchy: <id>.md), in a folder that executors share; returns (slug, files).

    Files are written where the rows are, each under a name of its own first.
    """
    src = records.select(slug(F.col("hierarchy")).alias("slug"), "id", markdown().alias("text"))

    def run(batches: Iterator) -> Iterator:
        import os
        import uuid
        from collections import Counter

        import pyarrow as pa

        n: Counter = Counter()
        for b in batches:
            for s, i, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                os.makedirs(f"{folder}/{s}", exist_ok=True)
                part = f"{folder}/{s}/.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as out:
                    out.write(t)
                os.replace(part, f"{folder}/{s}/{i}.md")
                n[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["slug", "files"])

    return src.mapInArrow(run, "slug string, files long").groupBy("slug").agg(F.sum("files").alias("files"))


def hierarchy_pages(records: DataFrame) -> DataFrame:
    """(hierarchy, n, head, text): the sections of each hierarchy's page, one row each; n is their number, head what stands before them.

    A page may be larger than a row or a machine's memory can be, so it is
    never put together: its sections lie in one partition, by id, for readers
    that take them one after another. write_hierarchy_lines() splits pages.
    """
    sizes = records.groupBy("hierarchy").agg(F.count("*").alias("n")).withColumnRenamed("hierarchy", "__h")
    head = F.concat(F.lit("# "), F.col("hierarchy"), F.lit("\n\n> "), F.col("n").cast("string"), F.lit(" concepts in this hierarchy.\n\n"))
    counted = records.join(F.broadcast(sizes), F.col("hierarchy").eqNullSafe(F.col("__h"))).select("hierarchy", "n", "id", markdown_section().alias("text"))
    return counted.repartition("hierarchy").sortWithinPartitions("hierarchy", "id", "text").select("hierarchy", "n", head.alias("head"), "text")


def page_digests(records: DataFrame) -> DataFrame:
    """(hierarchy, n, digest): the MD5 of each hierarchy's page, taken section by section."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        def row(page, n, md5):
            return pa.RecordBatch.from_arrays([pa.array([page], pa.string()), pa.array([n], pa.int64()), pa.array([None if page is None else md5.hexdigest()], pa.string())], ["hierarchy", "n", "digest"])

        at = None  # the page, its number of sections and the digest so far
        for b in batches:
            pages, sizes, heads, texts = (b.column(k) for k in range(4))
            for i, page in enumerate(pages.to_pylist()):
                if at is None or at[0] != page:
                    if at is not None:
                        yield row(*at)
                    at = page, sizes[i].as_py(), hashlib.md5((heads[i].as_py() or "").encode(), usedforsecurity=False)
                if (text := texts[i].as_py()) is not None:
                    at[2].update(text.encode())
        if at is not None:
            yield row(*at)

    return hierarchy_pages(records).mapInArrow(run, "hierarchy string, n long, digest string")


def write_hierarchy_lines(records: DataFrame, folder: str, mode: str = "error") -> None:
    """The sections of each hierarchy as text files below slug=<hierarchy slug>, by id, split as the rows are."""
    src = records.select(slug(F.col("hierarchy")).alias("slug"), "id", markdown_section().alias("value"))
    src.repartitionByRange("slug", "id").sortWithinPartitions("slug", "id").select("slug", "value").write.mode(mode).partitionBy("slug").text(folder)


def pretty(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as indented JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias(name))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
