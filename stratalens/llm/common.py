"""What the operators of this subpackage share: stage tables, skew-safe joins, bitmaps, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_made: list[tuple[SparkSession, str]] = []

#: Bytes of one Arrow batch on its way to Python, where the session does not say otherwise.
BATCH_BYTES = str(8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder in the temporary
    one serves a local session; a cluster must name one, as its executors would each write to their own disk."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="stratalens-")
    return _own_dir


def in_arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, as texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size."""
    in_arrow_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet stage table in the shared folder and read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalens-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def drop(*frames: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for df in frames:
        for k, (spark, path) in enumerate(_made):
            if path == df._stage:
                _remove(spark, path)
                del _made[k]
                break


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def own_names(df: DataFrame) -> dict[str, str]:
    """Plain names c0, c1 … for df's columns, so that no helper column clashes with them."""
    return {c: f"c{k}" for k, c in enumerate(df.columns)}


def first_row(df: DataFrame) -> Column:
    """Aggregate: of rows with df's columns, the one whose columns sort first, as the struct _row. Maps have no order
    and decide nothing."""
    ordered = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.min_by(F.struct(*df.columns), F.struct(*ordered)).alias("_row")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- bounded membership bitmaps -------------------------------------------------------------

BITMAP_MAX_BITS = 1 << 27  # 32 MB of words, whatever the number of keys: past it the filter only lets more rows through


def bitmap(keys: DataFrame, col: str, n_keys: int) -> tuple[DataFrame, int]:
    """A hashed bitmap of a key column: at most BITMAP_MAX_BITS / 32768 rows of 1,024 words of 32 bits."""
    bits = 1 << 16
    while bits < min(16 * n_keys, BITMAP_MAX_BITS):
        bits <<= 1
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    rows = keys.where(F.col(col).isNotNull()).select(F.shiftright(at, 15).alias("_bucket"), (at % 32768).alias("_bit"))
    made = rows.groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bitmap"))
    words = F.expr("transform(sequence(0, 1023), k -> cast(conv(hex(substring(_bitmap, 4 * k + 1, 4)), 16, 10) AS bigint))")
    return made.select("_bucket", words.alias("_words")), bits


def tested_in(df: DataFrame, col: str, made: tuple[DataFrame, int]) -> DataFrame:
    """df with _maybe: false for rows whose key is certainly not in the bitmap. No shuffle of df."""
    rows, bits = made
    at = F.pmod(F.xxhash64(col), F.lit(bits))
    # a word's first byte is its highest; within a byte the lowest bit comes first
    bit = F.expr("shiftright(get(_words, cast(_bit div 32 AS int)), cast(24 - (_bit % 32) div 8 * 8 + _bit % 8 AS int)) & 1")
    found = df.withColumns({"_bucket": F.shiftright(at, 15), "_bit": at % 32768}).join(F.broadcast(rows), "_bucket", "left")
    return found.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bit", "_words")


def maybe_in(df: DataFrame, col: str, made: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be in the bitmap: every member, and few others."""
    return tested_in(df, col, made).where("_maybe").drop("_maybe")


def without(df: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """df less the rows whose keys are in gone, a stage table with columns of those names. Rows that a bitmap
    of the first key clears stay where they are; only the others are joined."""
    tested = tested_in(df, keys[0], bitmap(gone, keys[0], gone.count()))
    rest = tested.where("_maybe").join(gone.select(*keys), keys, "left_anti").select(*df.columns)
    return tested.where("NOT _maybe").select(*df.columns).unionByName(rest)


# -- joining rows to groups of which some are very large ------------------------------------

HEAVY_KEYS = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to one-row-per-key groups. A key with more than total / HEAVY_KEYS rows is heavy; there
    are at most HEAVY_KEYS of those, so they are broadcast, and only the others meet in a shuffle.
    Both inputs should be stage tables: each is read twice."""
    limit = max(total // HEAVY_KEYS, 100)
    values = [c for c in groups.columns if c not in keys]
    heavy = F.broadcast(groups.where(F.col(count) > limit).withColumn("_heavy", F.lit(True)))
    first = rows.join(heavy, keys, "left")
    hot = first.where(F.col("_heavy")).drop("_heavy")
    rest = first.where(F.col("_heavy").isNull()).drop("_heavy", *values)
    return hot.unionByName(rest.join(groups.where(F.col(count) <= limit), keys, how))


# -- connected components ------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest reachable node.

    Alternating large-star and small-star rounds: minima are combined map-side, each round is a stage
    table in the shared folder, and nothing but two numbers a round comes to the driver.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        then = save(small, "edges")
        state = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = then
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
