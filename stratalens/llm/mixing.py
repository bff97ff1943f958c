"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, own_names, save

NONE = "(none)"
BINS = 4096  # seeded order keys of a leaf are first summed in this many ranges
BROADCAST_ROWS = 100_000

Path = tuple[str, ...]


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(total: int, parts: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Share total among siblings by weight, none beyond its capacity; what one cannot take goes to the others
    by weight. Whole tokens: remainders go to the largest fractions, then by name."""
    got = dict.fromkeys(parts, 0)
    open_ = {k for k, (w, c) in parts.items() if w > 0 and c > 0}
    left = min(total, sum(parts[k][1] for k in open_))
    while left > 0 and open_:
        weight = sum(parts[k][0] for k in open_)
        full = {k for k in open_ if left * parts[k][0] / weight >= parts[k][1]}
        if full:
            for k in full:
                got[k] = parts[k][1]
                left -= parts[k][1]
            open_ -= full
            continue
        share = {k: left * parts[k][0] / weight for k in open_}
        for k in open_:
            got[k] = int(share[k])
        rest = left - sum(got[k] for k in open_)
        for k in sorted(open_, key=lambda k: (int(share[k]) - share[k], k))[:rest]:
            got[k] += 1
        break
    return got


def budgets(held: dict[Path, int], weights: dict[Path, float], total: int, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. Top-down: every node shares its budget among its children by weight, within what
    the subtrees hold in `epochs` passes. A shortage so stays with siblings while they can take it, and
    only reaches an ancestor's other children when its whole branch is full. A weight not given is 1."""
    out: dict[Path, int] = {}
    # what each node holds, summed from its leaves, and its children
    below: dict[Path, int] = {}
    kids: dict[Path, list[str]] = {}
    for p, n in held.items():
        for depth in range(len(p)):
            if p[: depth + 1] not in below:
                kids.setdefault(p[:depth], []).append(p[depth])
            below[p[: depth + 1]] = below.get(p[: depth + 1], 0) + n * epochs
    open_ = [((), total)] if held else []
    while open_:
        node, budget = open_.pop()
        for k, n in fill(budget, {k: (weights.get((*node, k), 1.0), below[*node, k]) for k in kids[node]}).items():
            if (*node, k) in kids:
                open_.append(((*node, k), n))
            else:
                out[*node, k] = n
    return out


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[Path, float],
    fraction: float,
    epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """The rows of docs that are chosen, once for each epoch, with all their columns and _epoch, _tokens, _take.

    levels names the tree from the top (domain, language, source) and gives each level's column; nulls are a
    child of their own. The whole budget is `fraction` of all tokens (words by default). A leaf that is
    given more than it holds repeats in epochs; each epoch orders the leaf by a hash of seed, epoch and
    doc_id, and the last one is a token-prefix of that order: _take is less than _tokens for the document
    that the budget ends in. Rows that repeat a doc_id, or have none, have one place in the order; where the budget ends
    in such a place they follow each other in the order of the table, so that no more than the budget is taken. Rows
    without tokens are never chosen; an empty table gives an empty result. Columns of docs may have any names but those
    three.

    On the driver is one entry a leaf, that is, a source: some 300 bytes each.

    Prefixes need no sort of a leaf: tokens are summed by range of the hash, and only the range in which the
    budget ends is looked at row by row. The decision is one row per leaf and epoch; texts never move.
    """
    spark = docs.sparkSession
    own = own_names(docs)
    n = word_count(F.col(text_col)) if tokens is None else tokens
    # as n > 0, but read only as far as the first word
    some = F.col(text_col).rlike(r"[^\x20\x09-\x0D]") if tokens is None else n > 0
    keys = [f"_level{k}" for k in range(len(levels))]
    leaf = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in zip(keys, levels.values(), strict=True)]
    rows = docs.where(some).select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], *leaf, n.alias("_tokens"), F.col(id_col).cast("string").alias("_id"))
    slim = save(rows.select(*keys, "_id", "_tokens"), "leaves")
    held = {tuple(r[k] for k in keys): r["n"] for r in slim.groupBy(*keys).agg(F.sum("_tokens").alias("n")).collect()}
    given = budgets(held, weights, int(fraction * sum(held.values())), epochs)
    plan = []
    for path, target in given.items():
        for e in range(epochs):
            want = min(held[path], target - e * held[path])
            if want > 0:
                plan.append((*path, e, int(want), want == held[path]))
    schema = ", ".join(f"{k} string" for k in keys) + ", _epoch int, _want long, _whole boolean"
    wanted = spark.createDataFrame(plan, schema)
    small = F.broadcast if len(plan) <= BROADCAST_ROWS else lambda x: x

    def order(id_: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_epoch", id_), 2)

    width = (1 << 62) // BINS
    part = slim.join(small(wanted.where("NOT _whole")), keys).withColumn("_u", order(F.col("_id"))).withColumn("_bin", F.floor(F.col("_u") / F.lit(width)).cast("int"))
    by_leaf = [*keys, "_epoch", "_want"]
    running = Window.partitionBy(*by_leaf).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = part.groupBy(*by_leaf, "_bin").agg(F.sum("_tokens").alias("n")).withColumn("upto", F.sum("n").over(running))
    ends = ends.where("upto >= _want AND upto - n < _want").select(*by_leaf, F.col("_bin").alias("_end"), (F.col("upto") - F.col("n")).alias("_before"))
    inside = part.join(small(ends), by_leaf).where("_bin = _end").groupBy(*by_leaf, "_before", "_u").agg(F.sum("_tokens").alias("n"))
    running = Window.partitionBy(*by_leaf).orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.col("_before") + F.sum("n").over(running)).where("upto >= _want AND upto - n < _want")
    cut = cut.select(*keys, "_epoch", F.col("_u").alias("_cut"), (F.col("_want") - F.col("upto") + F.col("n")).alias("_last"))
    decided = save(wanted.join(cut, [*keys, "_epoch"], "left"), "decided")
    drop(slim)
    placed = rows.join(small(decided), keys).withColumn("_u", order(F.col("_id")))
    result = [*own.values(), "_epoch", "_tokens"]
    whole = placed.where("_whole OR _u < _cut").select(*result, F.col("_tokens").alias("_take"))
    # rows at the place where the budget ends, as a rule one a leaf: running sums over each task's rows, then over tasks
    last = save(placed.where("NOT _whole AND _u = _cut").withColumn("_row", F.monotonically_increasing_id()), "last").withColumn("_task", F.shiftright("_row", 33))
    tasks = last.groupBy(*keys, "_epoch", "_task").agg(F.sum("_tokens").alias("n"))
    ahead = Window.partitionBy(*keys, "_epoch").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(*keys, "_epoch", "_task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_epoch", "_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_last") - F.col("_ahead") - F.coalesce(F.sum("_tokens").over(within), F.lit(0))
    ending = last.join(tasks, [*keys, "_epoch", "_task"]).withColumn("_take", F.least(F.col("_tokens"), room)).where("_take > 0").select(*result, "_take")
    return whole.unionByName(ending).toDF(*docs.columns, "_epoch", "_tokens", "_take")
