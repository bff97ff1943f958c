"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, components, drop, first_row, in_arrow, maybe_in, own_names, save, tested_in
from .tokens import U64, chunks, mix, tidy, words

#: Two collections of COLLECTION bands of BAND minhashes; a table's key is a pair, one band from each.
#: 24 minhashes serve 36 tables of 4, where independent tables would take 144. At a similarity of 0.8 a
#: pair shares a band with probability 0.64, so it meets in some table with (1 - 0.36^6)^2 = 0.9956.
COLLECTION, BAND = 6, 2
#: Members of one pivot are compared in blocks of at most about this many.
BLOCK = 512
MARK = U64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; of all its words if there are fewer."""
    out = []
    odd = np.random.default_rng(k).integers(1, 2**63, k, dtype=np.uint64) | U64(1)
    for a, b in chunks(texts):
        (h,), per = words(texts[a:b], lower=True)
        at = 0
        for n in per.tolist():
            own = h[at : at + n]
            at += n
            if n >= k:
                s = own[: n - k + 1] * odd[0]
                for j in range(1, k):
                    s = s + own[j : n - k + 1 + j] * odd[j]
                out.append(np.unique(mix(s)))
            elif n:
                out.append(mix((own * odd[:n]).sum(keepdims=True) + U64(n)))
            else:
                out.append(own)
    return out


def _minhash(sets: list[np.ndarray]) -> np.ndarray:
    m = 2 * COLLECTION * BAND
    rng = np.random.default_rng(2024)
    mul, add = (rng.integers(1, 2**63, (m, 1), dtype=np.uint64) | U64(1) for _ in range(2))
    out = np.zeros((len(sets), m), np.int32)
    for k, s in enumerate(sets):
        if len(s):
            low = [(s[a : a + 4096] * mul + add).min(axis=1) for a in range(0, len(s), 4096)]
            out[k] = (np.minimum.reduce(low) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def _slices(batches, rows: int = 1000):
    """Batches in parts, so that a task holds the sets of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signatures(k: int):
    def run(batches):
        for batch in _slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sets = shingle_sets(texts, k)
            sums = [np.array([(mix(s ^ U64(c))).sum(dtype=U64) for s in sets], U64).view(np.int64) for c in (11, 77)]
            low = _minhash(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *map(pa.array, sums),
                    pa.ListArray.from_arrays(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32), low.ravel()),
                ],
                names=["doc_id", "t", "n", "s1", "s2", "low"],
            )

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in _slices(batches):
            left, right = (shingle_sets([t or b"" for t in batch.column(c).cast(pa.binary()).to_pylist()], k) for c in (2, 3))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            every = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - both
            ok = pa.array(100 * both >= percent * every)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (0, 1)], names=["a", "b"])

    return run


def _deltas(k: int):
    """What a member's set has that its pivot's has not, and the other way round, as one sorted array of marked hashes."""

    def run(batches):
        for batch in _slices(batches):
            pivots, members = (shingle_sets([t or b"" for t in batch.column(c).cast(pa.binary()).to_pylist()], k) for c in (5, 6))
            delta, base, minus = [], [], []
            for p, m in zip(pivots, members, strict=True):
                gone = np.setdiff1d(p, m, assume_unique=True)
                delta.append(np.sort(np.concatenate((np.setdiff1d(m, p, assume_unique=True), gone ^ MARK))).view(np.int64))
                base.append(len(p))
                minus.append(len(gone))
            flat = np.concatenate(delta) if delta else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, delta)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(base, pa.int64()), pa.array(minus, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                names=["a", "b", "n", "component", "outside", "base", "minus", "delta"],
            )

    return run


def _link_blocks(percent: int):
    def run(key, table):
        """Links of a block of members outside the pivot's component with a block of any members: one for each two components
        that they join, so fewer than there are members. Sets share base - minus - minus' + common deltas."""
        role = table.column("role").to_numpy()
        b, n, component = (table.column(c).to_numpy() for c in ("b", "n", "component"))
        base, minus = (table.column(c).to_numpy() for c in ("base", "minus"))
        lists = table.column("delta").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        every, ours = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        owner = np.repeat(np.arange(len(every)), at[every + 1] - at[every])
        values = np.concatenate([flat[at[i] : at[i + 1]] for i in every]) if len(every) else flat[:0]
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        left, right = [], []
        # the component of each member of the block, as joined so far
        label = np.unique(component, return_inverse=True)[1]
        for i in ours:
            if (label[every] == label[i]).all():
                continue
            own = flat[at[i] : at[i + 1]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            size = hi - lo
            hits = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(own) else lo
            both = base[i] - minus[i] - minus[every] + np.bincount(owner[hits], minlength=len(every))
            ok = (100 * both >= percent * (n[i] + n[every] - both)) & (label[every] != label[i])
            found = every[ok]
            reached, first = np.unique(label[found], return_index=True)
            left += [b[i]] * len(first)
            right += b[found[first]].tolist()
            label[np.isin(label, reached)] = label[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, nulls: bool) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, t, n, s1, s2) of every row, t being a hash of its text; one row (n, s1, s2, size, component, d, t) for each
    class of equal sets, where (d, t) is the first row of its component; and the rows in classes."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = save(in_arrow(src.select("doc_id", "text", "t"), tidy(_signatures(k)), "doc_id long, t long, n long, s1 long, s2 long, low array<int>"), "signatures")
    d = F.coalesce("doc_id", F.lit((1 << 63) - 1))  # null ids come last
    # a class's number is its own, whatever ids repeat; it stays as written, and follows the order of first rows: a
    # pivot, the smallest of its bucket, so is the first document, which copies are most often made from
    sets = rows.where("n > 0" + ("" if nulls else " AND doc_id IS NOT NULL")).groupBy("n", "s1", "s2")
    sets = sets.agg(F.min(F.struct(d.alias("d"), "t")).alias("first"), F.count("*").alias("size"), F.first("low").alias("low"))
    sets = save(sets.repartitionByRange("first").sortWithinPartitions("first").withColumn("rep", F.monotonically_increasing_id()), "sets")
    total = sets.agg(F.sum("size")).first()[0] or 0

    def band(c: int) -> str:
        half = c * COLLECTION * BAND
        return "array(" + ", ".join(f"xxhash64({j}, " + ", ".join(f"low[{half + j * BAND + i}]" for i in range(BAND)) + ")" for j in range(COLLECTION)) + ")"

    tables = sets.select("rep", "n", F.explode(F.expr(f"flatten(transform({band(0)}, x -> transform({band(1)}, y -> xxhash64(x, y))))")).alias("key"))
    met = save(tables.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1"), "keys")
    n_met = met.count()
    buckets = save(maybe_in(tables, "key", bitmap(met, "key", n_met)).join(met, "key").select("key", "pivot", "rep", "n"), "buckets")
    firsts = sets.select("rep", "first.d", "first.t").join(buckets.select("rep").distinct(), "rep", "left_semi")
    wanted = save(firsts, "wanted")
    places = wanted.groupBy("d", "t").agg(F.collect_list("rep").alias("reps"))
    texts = maybe_in(src, "t", bitmap(wanted, "t", wanted.count())).withColumn("d", d).join(places, ["d", "t"])
    texts = save(texts.groupBy("d", "t").agg(F.first("text").alias("text"), F.first("reps").alias("reps")).select(F.explode("reps").alias("rep"), "text"), "texts")
    star = save(buckets.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "n").distinct(), "star")
    sizes = sets.select(F.col("rep").alias("a"), F.col("n").alias("pivot_n"))
    left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    near = star.join(sizes, "a").where(f"100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)")
    first = save(in_arrow(near.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), tidy(_confirm(k, percent)), "a long, b long"), "links")
    found = save(components(first), "components")

    # groups of a pivot with members outside its component and others to compare them with
    own = found.select(F.col("node").alias("b"), F.col("component"))
    main = found.select(F.col("node").alias("a"), F.col("component").alias("main"))
    placed = star.join(own, "b", "left").join(main, "a", "left").withColumn("component", F.coalesce("component", "b")).withColumn("outside", F.col("component") != F.coalesce("main", "a"))
    placed = save(placed.select("a", "b", "n", "component", "outside"), "placed")
    mixed = placed.groupBy("a").agg(F.count("*").alias("members"), F.count_if("outside").alias("others")).where("members > 1 AND others > 0")
    mixed = save(mixed.select("a", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("others") / BLOCK).cast("int").alias("outer")), "mixed")
    both = placed.join(mixed, "a", "left_semi").join(left, "a").join(right, "b").select("a", "b", "n", "component", "outside", "text_a", "text_b")
    deltas = save(in_arrow(both, tidy(_deltas(k)), "a long, b long, n long, component long, outside boolean, base long, minus long, delta array<long>"), "deltas").join(mixed, "a")
    part = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = deltas.withColumn("role", F.lit(0)).withColumn("x", upto("outer")).withColumn("y", part("blocks"))
    others = deltas.where("outside").withColumn("role", F.lit(1)).withColumn("x", part("outer")).withColumn("y", upto("blocks"))
    second = save(members.unionByName(others).groupBy("a", "x", "y").applyInArrow(_link_blocks(percent), "a long, b long"), "links")
    final = save(components(first.union(second)).withColumnRenamed("node", "rep"), "components")

    drop(buckets, star, placed, texts, wanted)
    named = sets.select("n", "s1", "s2", "rep", "size", "first").join(final, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    classes = save(named.join(heads, "component").select("n", "s1", "s2", "size", "head.*"), "classes")
    return rows.select("doc_id", "t", "n", "s1", "s2"), classes, total


def minhash_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct k-word shingles (A-Z lower-cased; words are runs of
    other than ASCII white space) have a Jaccard similarity of percent / 100 or more; component_id is the
    smallest doc_id reachable, kept marks it. A text of fewer than k words is one shingle; a null or
    wordless text has none and stays alone. Rows that repeat a doc_id are linked by their own texts.
    Extra columns are ignored. Rows with a null doc_id stay alone, not kept.

    Equal sets are one class from the start, told by their size and two sums of 64-bit hashes: a class is wrong only where
    two sets of a size agree in all 128 bits. Classes that share a table key meet at one
    member, their pivot: one pair a member, never all pairs; confirmed links give components. Members of a
    pivot that are outside its component are then compared, in blocks, with all its members, on their
    full sets held as differences from the pivot's; tasks return one link for each two components joined. Any two
    classes that share a key share its pivot, so none of their links is lost.
    """
    rows, classes, total = _grouped(docs, k, percent, id_col, text_col, nulls=False)
    out = attach(rows, classes.drop("t"), ["n", "s1", "s2"], "size", total)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("d", F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less its near copies: one row of each group of linked documents stays, that of the smallest id, with all its
    columns, whatever their names. Here null ids take part and come last; of rows that repeat id and text the one
    whose columns sort first stays, and where an id repeats with other texts, so does the id's first text by hash. Texts
    without words are linked with nothing and stay; an empty table stays empty.
    """
    rows, classes, total = _grouped(docs, k, percent, id_col, text_col, nulls=True)
    groups = save(classes.groupBy("d", "t").agg(F.sum("size").alias("rows")).where("rows > 1"), "groups")
    # every row of a group of several: its text's hash, with the row that the group keeps
    some = classes.join(groups, ["d", "t"], "left_semi").select("n", "s1", "s2", F.col("d").alias("_d"), F.col("t").alias("_keep"), "size")
    d = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    placed = attach(rows.withColumn("_id", d), save(some, "some"), ["n", "s1", "s2"], "size", total, how="inner").where("_keep IS NOT NULL")
    gone = save(placed.select("_id", F.col("t").alias("_t"), ((F.col("_id") == F.col("_d")) & (F.col("t") == F.col("_keep"))).alias("_stays")).distinct(), "gone")
    own = own_names(docs)
    named = docs.toDF(*own.values()).withColumns({"_id": F.coalesce(F.col(own[id_col]).cast("long"), F.lit((1 << 63) - 1)), "_t": F.xxhash64(F.col(own[text_col]).cast("string"))})
    tested = tested_in(named, "_t", bitmap(gone, "_t", gone.count()))
    rest = tested.where("_maybe").join(gone, ["_id", "_t"], "left")
    alone = rest.where("_stays IS NULL").select(*own.values())
    first = rest.where("_stays").groupBy("_id", "_t").agg(first_row(docs.toDF(*own.values())))
    return tested.where("NOT _maybe").select(*own.values()).unionByName(alone).unionByName(first.select("_row.*")).toDF(*docs.columns)
