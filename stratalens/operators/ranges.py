"""Line-to-range joins without a range join: one sort of both sides per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_containing(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, name: str, by: list[str] | None = None) -> DataFrame:
    """points with `name` of the last range that starts at or before them, null if that range has already ended
    (even where an outer one still holds). Both sides are sorted together once per key.

    With `by`, which names `at`, points that agree there are one, of all their keys' ranges: (*by, name)."""
    types = dict(ranges.dtypes)
    left = points.withColumns({"_at": F.col(at), "_side": F.lit(1), "_range": F.lit(None).cast(f"struct<s:{types[start]},n:{types[name]},e:{types[end]}>")})
    right = ranges.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(start).alias("s"), F.col(name).alias("n"), F.col(end).alias("e")).alias("_range"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_at", "_side", F.col("_range.n")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_range", ignorenulls=True).over(w)
    hit = both.withColumn("_last", last).where("_side = 1")
    if by:
        hit = hit.groupBy(*by).agg(F.max("_last").alias("_last")).withColumn("_at", F.col(at))
    return hit.withColumn(name, F.when(F.col("_last.e") >= F.col("_at"), F.col("_last.n"))).drop("_at", "_side", "_range", "_last")


def containing(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, name: str, innermost: bool, by: list[str] | None = None) -> DataFrame:
    """points with `name` of the smallest (innermost) or else latest-starting range that holds them, null if none does.
    Points that repeat stay as often as they are there. Ties go to the range that starts first, then by name.

    A range of n places is listed in the one or two cells of the least power of two that is n or more; a point looks
    into one cell of each size that occurs: an equi-join, however long a range is. With `by`, points that agree there
    are one, of the ranges of all of them: (*by, name).
    """
    size = F.ceil(F.log2(F.col(end) - F.col(start) + 1)).cast("int")
    listed = ranges.where(F.col(end) >= F.col(start)).select(*key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(name).alias("_n"), size.alias("_size"))
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_size"))).cast("long")
    listed = listed.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("_s")), cell(F.col("_e"))))))
    sizes = [r[0] for r in listed.select("_size").distinct().collect()]
    own = points.columns
    pts = points.groupBy(*own).agg(F.count("*").alias("_times"))
    probes = pts.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array(F.lit(0)))).withColumn("_cell", cell(F.col(at)))
    met = listed.withColumnsRenamed({k: f"_k{j}" for j, k in enumerate(key)} | {"_size": "_size2", "_cell": "_cell2"})
    on = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(key)] + [F.col("_size") == F.col("_size2"), F.col("_cell") == F.col("_cell2"), F.col(at).between(F.col("_s"), F.col("_e"))]
    rank = F.struct((F.col("_e") - F.col("_s")).alias("a"), F.col("_s").alias("b"), F.col("_n")) if innermost else F.struct((-F.col("_s")).alias("a"), F.col("_e").alias("b"), F.col("_n"))
    if by:
        return probes.join(met, on, "left").groupBy(*by).agg(F.min_by("_n", F.when(F.col("_s").isNotNull(), rank)).alias(name))
    best = probes.join(met, on, "left").groupBy(*own).agg(F.first("_times").alias("_times"), F.min_by("_n", F.when(F.col("_s").isNotNull(), rank)).alias(name))
    return best.select(*own, name, F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_again")).drop("_again")
