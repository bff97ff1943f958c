"""Writers: index tables, record lines, tab-separated hashes, catalogues and flowcharts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.operators.corpus import lines, postings


def write_index(corpus: DataFrame, path: str) -> None:
    """The index of a corpus of (path, folder, ext, content, doc_id): files, lines and postings as Parquet tables."""
    corpus.write.mode("overwrite").partitionBy("ext").parquet(f"{path}/files")
    lines(corpus).write.mode("overwrite").parquet(f"{path}/lines")
    postings(corpus).write.mode("overwrite").parquet(f"{path}/postings")


def write_hashes(bodies: DataFrame, path: str) -> None:
    """hash, lines, name and path of every function, tab-separated."""
    bodies.select("body_hash", "lines", "name", "path").write.mode("overwrite").option("sep", "\t").csv(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record a line."""
    records.write.mode("overwrite").json(path)


def merge_catalog(old: DataFrame, new: DataFrame, key: str, size: str) -> DataFrame:
    """Entries of both catalogues by key: the larger one counts, the others' sources are kept as provenance."""
    both = old.unionByName(new)
    best = Window.partitionBy(key).orderBy(F.desc(size), "source")
    ranked = both.withColumn("_r", F.row_number().over(best)).withColumn("provenance", F.array_sort(F.collect_set("source").over(Window.partitionBy(key))))
    return ranked.where("_r = 1").drop("_r")


def merge_vectors(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A vector cache after an upsert: new rows replace old ones of their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def mermaid(edges: DataFrame) -> DataFrame:
    """A flowchart's lines for edges of (src, dst, calls), heaviest first; one row a line, so no task holds the chart."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    rows = edges.select("calls", F.concat(F.lit("  "), name("src"), F.lit(" -->|"), F.col("calls").cast("string"), F.lit("| "), name("dst")).alias("line"))
    return rows.orderBy(F.desc("calls"), "line").select("line")
