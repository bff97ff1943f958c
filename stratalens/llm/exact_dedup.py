"""Exact dedup over an extendible-hash index kept in shared files. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, attach, bitmap, drop, first_row, maybe_in, own_names, save, tested_in

#: The directory never looks at more than this many leading hash bits (16,384 entries on the driver);
#: a bucket that is still overfull at that depth keeps its overflow chained, as in the classic structure.
MAX_DEPTH = 14


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Grow an extendible-hash directory: (prefix of max_depth bits, bucket, local depth) for each prefix.

    counts: keys by their leading max_depth bits. A bucket over capacity is split on its next bit; the
    directory doubles whenever the bucket's own depth has reached the global one.
    """

    def held(prefix: int, depth: int) -> int:
        low = prefix << (max_depth - depth)
        return sum(counts.get(p, 0) for p in range(low, low + (1 << (max_depth - depth))))

    depth, slots, buckets = 0, [0], {0: (0, 0)}  # bucket -> (prefix, local depth)
    open_ = [0]
    while open_:
        b = open_.pop()
        prefix, local = buckets[b]
        if local == max_depth or held(prefix, local) <= capacity:
            continue
        if local == depth:  # double
            slots = [s for s in slots for _ in range(2)]
            depth += 1
        new = len(buckets)
        buckets[b], buckets[new] = (prefix * 2, local + 1), (prefix * 2 + 1, local + 1)
        for at in range((prefix * 2 + 1) << (depth - local - 1), (prefix * 2 + 2) << (depth - local - 1)):
            slots[at] = new
        open_ += [b, new]
    wide = max_depth - depth
    order = {b: k for k, b in enumerate(dict.fromkeys(slots))}  # owners hold ascending key ranges
    return [(p, order[slots[p >> wide]], buckets[slots[p >> wide]][1]) for p in range(1 << max_depth)]


#: Rows of one text are first combined in this many parts, so that a text of a third of all rows is a few rows when it
#: reaches its owner.
PARTS = 32


def _index(docs: DataFrame, capacity: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, key, text_sha256) of all rows; the index's entries with more than one row, as key, bucket, chain,
    text_sha256, keep_id, group_size; and how many rows have a key of those."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("body"))
    rows = save(src.select("doc_id", F.xxhash64("body").alias("key"), F.sha2("body", 256).alias("text_sha256")), "rows")
    keys = save(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    counts = {r[0]: r[1] for r in keys.groupBy(prefix.alias("p")).count().collect()}
    grown = directory(counts, capacity)
    slots = F.broadcast(spark.createDataFrame(grown, "prefix int, bucket int, depth int").select("prefix", "bucket"))
    # an owner has whole buckets, or a key range of one that cannot be split further
    owners = max(max(x[1] for x in grown) + 1, -(-sum(counts.values()) // capacity))
    dealt = lambda df: df.withColumn("prefix", prefix).join(slots, "prefix").drop("prefix").repartitionByRange(owners, "bucket", "key")
    index = save(dealt(keys).sortWithinPartitions("bucket", "key"), "index")
    repeated = index.where("n > 1")
    some = repeated.agg(F.count("*"), F.sum("n")).first()
    again = maybe_in(src.withColumn("key", F.xxhash64("body")), "key", bitmap(repeated, "key", some[0]))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    combined = again.groupBy("key", "body", part.alias("part")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = dealt(combined).groupBy("bucket", "key", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("body")))
    entries = save(chained.where("group_size > 1").select("key", "bucket", "chain", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    drop(keys, index)
    return rows, entries, some[1] or 0


def exact_dedup(docs: DataFrame, capacity: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, chain_pos.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The largest
    doc_id of a group stays; of rows that repeat it, each stays. Null ids lose to any other id and
    are kept only where the whole group has none. An empty table gives an empty result; other
    columns of docs are ignored, whatever their names.

    1. A scan writes (doc_id, 64-bit key, SHA-256) to the shared folder; no text is shuffled.
    2. Keys are pre-aggregated and dealt to buckets of an extendible-hash directory grown from the
       histogram of leading bits; each owner task writes the key range of its buckets.
    3. Only texts whose key is in the index more than once move, found by a bounded bitmap in a second scan.
       Rows of one text are combined map-side, then sent through the directory to the owner of its bucket,
       which compares bytes within each key and chains the texts that collide on it.
    4. Rows are joined to their chain entry; very large groups by broadcast of a bounded list.
    """
    rows, entries, total = _index(docs, capacity, id_col, text_col)
    placed = attach(rows, entries, ["key", "text_sha256"], "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = placed.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast(T.LongType())))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.coalesce("chain", F.lit(1)).alias("chain_pos"))


def drop_copies(docs: DataFrame, capacity: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less its exact copies: one row of each group of equal texts stays, that of the largest id, with all its
    columns, whatever their names. Ids may be null or repeat: a null loses to any other, and of rows that repeat both
    id and text the one whose columns sort first stays. A null text is an empty one; an empty table stays empty.
    """
    _, entries, total = _index(docs, capacity, id_col, text_col)
    some = entries.select("text_sha256", "keep_id", "group_size")
    own = own_names(docs)
    body = ascii_lower(F.col(own[text_col]))
    tested = tested_in(docs.toDF(*own.values()).withColumn("_sha", F.sha2(body, 256)), "_sha", bitmap(some.withColumnRenamed("text_sha256", "_sha"), "_sha", some.count()))
    clear = tested.where("NOT _maybe").select(*own.values())
    rest = save(tested.where("_maybe").drop("_maybe"), "candidates")
    placed = attach(rest, some.select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size")), ["_sha"], "_size", total)
    alone = placed.where("_size IS NULL").select(*own.values())
    first = placed.where(F.col("_size").isNotNull() & F.col(own[id_col]).cast("long").eqNullSafe(F.col("_keep"))).groupBy("_sha").agg(first_row(docs.toDF(*own.values())))
    return clear.unionByName(alone).unionByName(first.select("_row.*")).toDF(*docs.columns)
