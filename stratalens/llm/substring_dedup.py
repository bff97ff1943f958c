"""Substring dedup by recompression of token sequences."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, bitmap, drop, in_arrow, maybe_in, save, tested_in, without
from .tokens import U64, chunks, mix, tidy, words

#: Rounds of recompression, and the most words that a symbol may stand for.
ROUNDS, WIDEST = 3, 8
#: Symbols of fewer words say nothing about a repeat and are not counted.
TELLING = 3


def recompress(word: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, widest: int = WIDEST) -> tuple[np.ndarray, ...]:
    """Symbols of many documents' words after some rounds: arrays (name, start, end, lo, hi, doc).

    The first step names runs of one word, in blocks of at most `widest`. Each round then names pairs: every
    symbol is on the left or the right side by a bit of its name, and a left one followed by a right one
    becomes a new symbol. A name is a hash of what it replaces, so it is the same wherever that occurs, on
    any machine, and whether two neighbours join depends on those two alone. [lo, hi) is the stretch of
    words that decided a symbol: two windows equal throughout that stretch hold the same symbol there. It
    reaches beyond the document where the edge had a part in it, so that no window holds it.
    """
    n = len(word)
    head = np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    run = np.repeat(np.arange(len(at)), size)
    cut = np.flatnonzero((np.arange(n) - at[run]) % widest == 0)
    start, count = cut, np.diff(np.append(cut, n))
    end = start + count
    name = np.where(count > 1, mix(word[cut] * U64(0x9E3779B97F4A7C15) + count.astype(U64)), word[cut])
    lo, hi, doc = at[run[cut]] - 1, at[run[cut]] + size[run[cut]] + 1, doc[cut]
    for r in range(rounds):
        if len(name) < 2:
            break
        right = (mix(name + U64(2 * r + 1)) & U64(1)).astype(bool)
        beside = doc[:-1] == doc[1:]
        joins = beside & ~right[:-1] & right[1:] & (end[1:] - start[:-1] <= widest)
        first, second = np.append(joins, False), np.append(False, joins)
        # a left symbol has looked at its right neighbour, a right one at its left
        look = np.where(right, np.arange(len(name)) - 1, np.arange(len(name)) + 1)
        edge = np.where(right, ~np.append(False, beside), ~np.append(beside, False))
        other = np.where(edge, 0, look)
        lo, hi = (
            np.where(edge, np.where(right, start - 1, lo), np.minimum(lo, lo[other])),
            np.where(edge, np.where(right, hi, end + 1), np.maximum(hi, hi[other])),
        )
        k = np.flatnonzero(first)
        name[k] = mix(name[k] * U64(0xD6E8FEB86659FD93) + mix(name[k + 1] + U64(r)))
        end[k] = end[k + 1]
        name, start, end, lo, hi, doc = (a[~second] for a in (name, start, end, lo, hi, doc))
    return name, start, end, lo, hi, doc


def _hash_words(texts: list[bytes]):
    """For each chunk of texts: its first text, word hashes (two of 64 bits), words a text, and where each text's words begin."""
    for a, b in chunks(texts):
        (h, g), per = words(texts[a:b], seeds=(1, 2))
        yield a, h, g, per, np.concatenate(([0], np.cumsum(per)))


def _symbols(window: int):
    """Telling symbols, in order in each document. A symbol that occurs once rules out the windows that hold its
    stretch; so between the ones before and after a row of shared symbols, starts from `after` of the one
    to `before` of the other stay open. name is null for a place where starts stay open at any rate."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            d, t1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a, h, _, per, first in _hash_words(texts):
                if not len(h):
                    continue
                name, start, end, lo, hi, doc = recompress(h, np.repeat(np.arange(len(per)), per))
                ok = (end - start >= TELLING) & (hi - lo <= window) & (per[doc] >= window)
                name, lo, hi, doc = name[ok], lo[ok], hi[ok], doc[ok]
                # starts that a lone symbol closes: hi - window .. lo
                close_from, close_to = hi - window, np.minimum(lo, first[doc + 1] - 1)
                useful = close_to >= np.maximum(close_from, first[doc])
                name, doc, close_from, close_to = name[useful], doc[useful], close_from[useful], close_to[useful]
                new = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
                begin, stop = first[doc], first[doc + 1] - window
                top = np.maximum.accumulate(close_to) if len(doc) else close_to  # documents follow each other
                before = np.where(new, begin, np.append(0, top[:-1]) + 1) if len(doc) else begin
                low = np.minimum.accumulate(close_from[::-1])[::-1] if len(doc) else close_from
                last = np.append(new[1:], True) if len(doc) else new
                after = np.where(last, stop, np.append(low[1:], 0) - 1) if len(doc) else stop
                at = np.arange(len(doc))
                idx = at - np.maximum.accumulate(np.where(new, at, 0)) if len(doc) else at
                # open at any rate: before the first closing range, between two that do not touch, after the last
                gap_from = np.concatenate((before, top[last] + 1 if len(doc) else before))
                gap_to = np.concatenate((close_from - 1, stop[last] if len(doc) else stop))
                gap_doc = np.concatenate((doc, doc[last] if len(doc) else doc))
                none = np.flatnonzero((per >= window) & (np.bincount(doc, minlength=len(per)) == 0))
                gap_from, gap_to, gap_doc = np.concatenate((gap_from, first[none])), np.concatenate((gap_to, first[none + 1] - window)), np.concatenate((gap_doc, none))
                real = gap_to >= gap_from
                gap_from, gap_to, gap_doc = gap_from[real], gap_to[real], gap_doc[real]
                owner = np.concatenate((doc, gap_doc))
                base = first[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((name.view(np.int64), np.zeros(len(gap_doc), np.int64))), mask=np.arange(len(owner)) >= len(doc)),
                        pa.array(d[a + owner]),
                        pa.array(t1[a + owner]),
                        pa.array(np.concatenate((idx, np.zeros(len(gap_doc), np.int64))).astype(np.int32)),
                        pa.array((np.concatenate((before, gap_from)) - base).astype(np.int32)),
                        pa.array((np.concatenate((after, gap_to)) - base).astype(np.int32)),
                    ],
                    names=["name", "d", "t1", "idx", "before", "after"],
                )

    return run


def _windows(window: int):
    """Keys of 128 bits, over all their words, of the windows that start in open ranges."""

    def run(batches):
        odd = np.random.default_rng(window).integers(1, 2**63, (2, window), dtype=np.uint64) | U64(1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            d, t1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ranges = batch.column(3).to_pylist()
            for a, h, g, per, first in _hash_words(texts):
                open_ = np.zeros(len(h) + 1, np.int64)
                for k in range(len(per)):
                    for r in ranges[a + k]:
                        open_[first[k] + max(r["a"], 0)] += 1
                        open_[min(first[k] + r["b"] + 1, len(h))] -= 1
                doc = np.repeat(np.arange(len(per)), per)
                at = np.arange(len(h))
                w = np.flatnonzero((np.cumsum(open_[:-1]) > 0) & (at + window <= first[doc + 1]))
                for c in range(0, len(w), 1 << 17):
                    p = w[c : c + (1 << 17)]
                    k1, k2 = np.zeros(len(p), U64), np.zeros(len(p), U64)
                    for j in range(window):
                        k1 += h[p + j] * odd[0, j]
                        k2 += mix(g[p + j] + odd[1, j]) * odd[0, j]
                    own = doc[p]
                    cols = (mix(k1).view(np.int64), mix(k2).view(np.int64), d[a + own], t1[a + own], (p - first[own]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["k1", "k2", "d", "t1", "place"])

    return run


def _cut(window: int):
    """Remove the words that the given window starts cover."""

    def run(batches):
        for batch in batches:
            out = []
            for raw, starts, whole in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = (raw or b"").split()
                n = len(own)
                if whole and n >= window:
                    own = []
                elif starts:
                    gone = np.zeros(n + 1, np.int64)
                    s = np.array(starts)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + window, -1)
                    stay = np.cumsum(gone[:n]) == 0
                    own = [own[k] for k in np.flatnonzero(stay).tolist()]
                kept = b" ".join(own)
                out.append((n, n - len(own), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row.

    Removes each word covered by a window of `window` consecutive words (runs of other than ASCII white
    space, unchanged) that also starts earlier: in a smaller doc_id, or earlier in the same document.
    Windows are judged on the input. A null text has no words. Rows that repeat a doc_id are
    one document: of an equal place in them neither is earlier; null ids come first. Other columns are ignored; an empty table gives an
    empty result.

    Texts equal to an earlier one are known from their hash: all their windows start earlier. The others
    are recompressed, in tasks, to symbols whose names agree everywhere. Symbols seen more than once are
    sent back to their documents; a window that holds a symbol seen once cannot repeat. The windows left
    are confirmed by 128-bit keys over all their words: every occurrence but the first is a repeat.
    """
    id_ = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("d"), text.alias("text"), F.xxhash64(text).alias("t1"))
    ids = save(src.select("d", "t1", F.xxhash64(F.lit(5), "text").alias("t2")), "ids")
    classes = save(ids.groupBy("t1", "t2").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    later = save(attach(ids, classes, ["t1", "t2"], "n", total).where("d > first").select("d", "t1").distinct(), "later")
    reps = without(src.select("d", "t1", "text"), ["d", "t1"], later)

    symbols = save(in_arrow(reps, tidy(_symbols(window)), "name long, d long, t1 long, idx int, before int, after int"), "symbols")
    names = save(symbols.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "names")
    shared = maybe_in(symbols, "name", bitmap(names, "name", names.count())).join(names, "name", "left_semi")
    order = Window.partitionBy("d", "t1").orderBy("idx")
    # rows that repeat a document have the same symbols: equal places count once
    rows = shared.withColumn("row", F.col("idx") - F.dense_rank().over(order))
    ranges = rows.groupBy("d", "t1", "row").agg(F.min_by("before", "idx").alias("a"), F.max_by("after", "idx").alias("b"))
    ranges = ranges.select("d", "t1", "a", "b").union(symbols.where("name IS NULL").select("d", "t1", "before", "after")).where("b >= a")
    ranges = save(ranges.groupBy("d", "t1").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    drop(symbols, names)

    open_ = maybe_in(reps, "d", bitmap(ranges, "d", ranges.count())).join(ranges, ["d", "t1"]).select("d", "t1", "text", "ranges")
    found = save(in_arrow(open_, tidy(_windows(window)), "k1 long, k2 long, d long, t1 long, place int"), "windows")
    again = save(found.groupBy("k1", "k2").agg(F.min(F.struct("d", "place")).alias("m"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.col("m.d").alias("m_d"), F.col("m.place").alias("m_place")), "again")
    some = maybe_in(found, "k1", bitmap(again, "k1", again.count())).join(again, ["k1", "k2"]).where("d > m_d OR (d = m_d AND place > m_place)")
    starts = save(some.groupBy("d", "t1").agg(F.collect_list("place").alias("starts")), "starts")
    drop(found, again, ranges)

    touched = save(starts.select("d", "t1").union(later), "touched")
    tested = tested_in(src, "d", bitmap(touched, "d", touched.count()))
    none = F.lit(None).cast("array<int>")
    clear = tested.where("NOT _maybe").select("doc_id", "text", none.alias("starts"), F.lit(False).alias("whole"))
    rest = tested.where("_maybe").join(starts, ["d", "t1"], "left").join(later.withColumn("whole", F.lit(True)), ["d", "t1"], "left")
    rest = rest.select("doc_id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    return in_arrow(clear.union(rest), tidy(_cut(window)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
