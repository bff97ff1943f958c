"""Embedding near-dedup with a forest of random-projection trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, in_arrow, save
from .tokens import tidy

TREES = 6
#: Trees are fitted on at most this many vectors (those with the smallest hashes); every vector is routed.
SAMPLE = 20_000
#: Vectors within this distance of a split, along its direction, go to both sides.
SPILL = 0.02
LEAF, BLOCK = 256, 1024
#: A tree has as many levels as its largest label needs, up to this: 2^20 leaves, or 8 MB of thresholds a tree.
DEEPEST = 20
#: Sample vectors that a node's threshold is taken from at least; a node with fewer takes those of its nearest ancestor.
FEWEST = 8


def grow(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree's directions, one a level, and thresholds of its inner nodes in heap order: splits at the sample's medians."""
    rng = np.random.default_rng(seed)
    way = rng.standard_normal((depth, sample.shape[1]))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    cut = np.zeros((1 << depth) - 1)
    held = {0: np.arange(len(sample))}
    for level in range(depth):
        x = sample @ way[level]
        below: dict[int, np.ndarray] = {}
        for node, own in held.items():
            cut[node] = np.median(x[own]) if len(own) else 0.0
            right = x[own] > cut[node]
            for child, part in ((2 * node + 1, own[~right]), (2 * node + 2, own[right])):
                below[child] = part if len(part) >= FEWEST else own
        held = below
    return way, cut


def route(x: np.ndarray, way: np.ndarray, cut: np.ndarray, depth: int, spill: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, leaf) pairs; rows near a split appear on both sides."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(depth):
        far = (x @ way[level])[rows] - cut[node]
        left, right = far <= spill, far > -spill
        rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
    return rows, node - ((1 << depth) - 1)


def _leaves(forests: dict):
    """forests has the depth and the trees for each dimension."""

    def run(batches):
        for batch in batches:
            v = batch.column("v").to_pylist()
            if not v:
                continue
            dims = np.array(list(map(len, v)))
            own: list[list[int]] = [[] for _ in v]
            for d in np.unique(dims).tolist():
                some = np.flatnonzero(dims == d)
                x = np.array([v[k] for k in some], np.float64)
                depth, forest = forests[d]
                for t, (way, cut) in enumerate(forest):
                    for r, leaf in zip(*(a.tolist() for a in route(x, way, cut, depth, SPILL)), strict=True):
                        own[some[r]].append((t << depth) + leaf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "label", "v", "size")), pa.array(own, pa.list_(pa.int32()))], names=["cid", "label", "v", "size", "leaves"])

    return run


def _compare(least: float):
    def run(key, table):
        """Links of one leaf, or of two blocks of it, that no earlier shared leaf has counted: partial link
        counts of each vector, and a spanning forest of the links."""
        leaf = key[1].as_py()
        first, second = key[2].as_py(), key[3].as_py()
        cid, size = table.column("cid").to_numpy(), table.column("size").to_numpy()
        block = table.column("block").to_numpy()
        x = np.array(table.column("v").to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        held = table.column("leaves").to_pylist()
        codes = np.full((len(held), max(map(len, held))), -1, np.int64)
        for k, h in enumerate(held):
            codes[k, : len(h)] = h
        links = np.zeros(len(x), np.int64)
        root = np.arange(len(x))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a in range(0, len(x), 256):
            near = x[a : a + 256] @ x.T >= least
            i, j = np.nonzero(near)
            i += a
            ok = i < j
            if first != second:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            for b in range(0, len(i), 20_000):
                p, q = i[b : b + 20_000], j[b : b + 20_000]
                shared = (codes[p][:, :, None] == codes[q][:, None, :]) & (codes[p] >= 0)[:, :, None]
                low = np.where(shared.any(axis=2), codes[p], 1 << 40).min(axis=1)
                p, q = p[low == leaf], q[low == leaf]
                np.add.at(links, p, size[q])
                np.add.at(links, q, size[p])
                # union without a call for pairs that already share their root
                for u, v in zip(p.tolist(), q.tolist(), strict=True):
                    if root[u] != root[v]:
                        u, v = find(u), find(v)
                        if u != v:
                            root[max(u, v)] = min(u, v)
        top = np.array([find(k) for k in range(len(x))])
        some = np.flatnonzero((links > 0) | (top != np.arange(len(x))) | np.isin(np.arange(len(x)), top[top != np.arange(len(x))]))
        return pa.table({"cid": cid[some], "links": links[some], "root": cid[top[some]]})

    return run


def embedding_dedup(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of the same non-null label and dimension are linked when their cosine in double precision is at
    least `least`. Null and zero vectors, and those with null or non-finite components, link with nothing;
    nor do rows with a null id. Equal vectors are one class from the start
    and count each other as links. Extra columns are ignored; an empty table gives an empty result.

    Every vector is routed down each of its dimension's TREES trees of random splits, with spill; vectors meet in leaves,
    each pair being counted in the first leaf it shares. Leaves larger than BLOCK are compared in blocks,
    so no task holds more than two blocks. Pairs never leave a task: it returns counts and a forest.
    """
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & good
    rows = save(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), F.concat(F.size(v), F.lit(":"), F.col(label_col).cast("string"))).alias("label"), v.alias("v")),
        "vectors",
    )
    keyed = rows.where("label IS NOT NULL").withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(7), "v"))
    classes = save(keyed.groupBy("label", "h", "g").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size"), F.first("v").alias("v")), "classes")
    each = classes.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.first(F.size("v")).alias("d"))
    stats = each.groupBy("d").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    total, held = sum(r.s for r in stats), sum(r.n for r in stats)
    forests = {}
    for r in stats:
        depth = int(min(DEEPEST, max(0, np.ceil(np.log2(max(r.most, 1) / LEAF)))))
        # a tree without splits needs no sample
        share = max(LEAF, round(SAMPLE * r.n / held)) if depth else 0
        sample = np.array([x[0] for x in classes.where(F.size("v") == r.d).orderBy("h", "cid").limit(share).select("v").collect()] if share else [], np.float64).reshape(-1, r.d)
        sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        forests[r.d] = depth, [grow(sample, depth, seed) for seed in range(TREES)]
    unit = classes.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).select("cid", "label", "size", F.transform("v", lambda c: c / F.col("norm")).alias("v"))
    placed = save(in_arrow(unit.select("cid", "label", "v", "size"), tidy(_leaves(forests)), "cid long, label string, v array<double>, size long, leaves array<int>"), "leaves")
    each = placed.withColumn("leaf", F.explode("leaves"))
    full = each.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = each.join(full.select("label", "leaf", "blocks"), ["label", "leaf"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other", "blocks")
    found = save(dealt.groupBy("label", "leaf", "first", "second").applyInArrow(_compare(least), "cid long, links long, root long"), "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    info = classes.join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
    info = save(info.select("label", "h", "g", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", F.col("cid")).alias("component")), "info")
    slim = save(rows.select("vec_id", "label", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g")), "slim")
    out = attach(slim, info, ["label", "h", "g"], "size", total)
    n_links = F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long")
    out = out.select("vec_id", n_links.alias("n_links"), F.coalesce("component", F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
