"""Graph operators on edge tables: bounded expansion, reachability and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): what each root reaches within depth steps, at its smallest depth. The frontier holds
    only nodes new to their root, so cycles end."""
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def ancestors(path, separator: str = "/"):
    """Every directory above a path, from the top."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), separator))
