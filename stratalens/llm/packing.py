"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, save
from .tokens import tidy, word_bpe

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def _pieces(path: str, capacity: int, end_id: int, cached_words: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe, part, seen = word_bpe(path), TaskContext.get().partitionId(), Counter()
        bpe.keep = cached_words
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank")}
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode([t or b"" for t in texts]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for c, v in zip(rows.values(), (doc, k, at // 4, n, zlib.crc32(own), part, seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return run


# -- the linear program ----------------------------------------------------------------------


def price(value: np.ndarray, units: int) -> dict[int, int]:
    """The multiset of sizes 1..units of total size at most units with the largest total value (knapsack DP)."""
    best = np.zeros(units + 1)
    took = np.zeros(units + 1, np.int64)
    for c in range(1, units + 1):
        way = best[c - 1 :: -1] + value[1 : c + 1]  # way[k]: the last item has size k + 1
        k = int(way.argmax())
        best[c], took[c] = way[k], k + 1
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], 0
    found, c = Counter(), units
    while c > 0:
        if took[c]:
            found[int(took[c])] += 1
        c -= max(int(took[c]), 1)
    return dict(found)


def config_lp(need: np.ndarray, units: int, step: float = 0.25, eta: float = 8.0, rounds: int = 4000) -> list[tuple[dict[int, int], float]]:
    """A near-optimal fractional cover of need[size] items by configurations, by multiplicative weights.

    A size's price falls exponentially with the share of its items already covered; each round adds
    the best-priced configuration until it covers a further `step` of its scarcest size.
    """
    here = need > 0
    done = np.zeros(units + 1)
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        low = done[here].min(initial=1.0)
        if low >= 1:
            break
        value = np.where(here, np.exp(-eta * (done - low)) / np.maximum(need, 1), 0.0)
        # a size that is covered has no price left
        value[done >= 1] = 0
        found = price(value, units)
        if not found:
            break
        times = step * min(need[s] / a for s, a in found.items())
        for s, a in found.items():
            done[s] += times * a / need[s]
        key = tuple(sorted(found.items(), reverse=True))
        used[key] = used.get(key, 0.0) + times
    return [(dict(k), x) for k, x in used.items()]


def round_off(counts: dict[int, int], capacity: int, grid: int, configs: list[tuple[list[int], int]], waste: int) -> tuple[np.ndarray, int]:
    """Realise configurations with true lengths, then pack the rest best-fit decreasing.

    A configuration's sequence is filled up with the longest pieces that fit, and is kept only if at
    most `waste` tokens stay empty and all its sizes could be met; else its pieces wait for the rest.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    below = list(range(capacity + 1))  # union-find: the longest length at most n that has pieces left
    taken = np.zeros(capacity + 1, np.int64)
    rows, sequences = [], 0

    def longest(n: int) -> int:
        root = n
        while root and not left[root]:
            root = below[root] if below[root] < root else root - 1
        while n > root:
            below[n], n = root, (below[n] if below[n] < n else n - 1)
        return root

    def realise(wanted: list[int], times: int, most_waste: int) -> None:
        nonlocal sequences
        while times > 0:
            used, room = Counter(), capacity

            def pick(most: int) -> int:
                n = longest(most)
                while n and used[n] >= left[n]:
                    n = longest(n - 1)
                return n

            for size in wanted:
                n = pick(min(size * grid, room))
                if n <= (size - 1) * grid:
                    return
                used[n] += 1
                room -= n
            while room and (n := pick(room)):
                used[n] += 1
                room -= n
            if not used or room > most_waste:
                return
            k = int(min(times, min(left[n] // a for n, a in used.items())))
            offset = 0
            for n, a in sorted(used.items(), reverse=True):
                rows.append((n, taken[n], taken[n] + a * k, sequences, a, offset))
                taken[n] += a * k
                left[n] -= a * k
                offset += n * a
            sequences += k
            times -= k

    for wanted, times in configs:
        realise(wanted, times, waste)
    while longest(capacity):
        realise([], 1 << 60, capacity)
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def plan(counts: dict[int, int], capacity: int, grid: int = 8) -> tuple[np.ndarray, int]:
    """Rows (length, rank from, rank to, first sequence, items a sequence, offset), and the number of sequences.

    Sizes of the program are lengths rounded up to the grid. Its solution is rounded three times, keeping
    configurations that waste nothing, no more than the program's own average, or anything; the rounding
    with the fewest sequences is taken. Work and rows are bounded by the number of lengths, not of pieces.
    """
    units = capacity // grid
    need = np.zeros(units + 1)
    for n, c in counts.items():
        need[min(units, -(-n // grid))] += c
    solved = config_lp(need, units)
    mean = max(0, int(capacity - sum(n * c for n, c in counts.items()) / max(sum(x for _, x in solved), 1)))
    configs = [([s for s, a in sorted(c.items(), reverse=True) for _ in range(a)], int(x)) for c, x in sorted(solved, key=lambda x: (-max(x[0]), sorted(x[0].items())))]
    return min((round_off(counts, capacity, grid, configs, waste) for waste in sorted({0, mean, capacity})), key=lambda x: x[1])


def _place(rows: np.ndarray):
    length, lo, _, first, each, offset = rows.T
    key = length << 48 | lo

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(key, n << 48 | rank, side="right") - 1
            k = rank - lo[at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 400_000) -> DataFrame:
    """Pack every document into sequences of at most capacity tokens; one row per piece.

    A document is its ids and end_id; only longer ones are cut, into full pieces and a last shorter one.
    A null text is empty (one piece holding end_id). Repeated rows are packed each; null ids are kept.
    An empty table gives an empty result. Only the length histogram (at most capacity rows) and the plan
    built from it (bounded by the lengths too) are on the driver. A piece's rank among those of its
    length is its rank in its task's output plus the counts of earlier tasks, so no length, however
    frequent, is ever sorted in one task. A worker keeps the ids of about cached_words words, some 200 bytes each: results
    are the same with any number, fewer take more time.
    """
    spark = docs.sparkSession
    pieces = save(in_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), tidy(_pieces(tokenizer, capacity, end_id, cached_words)), PIECE), "pieces")
    per = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}
    rows, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("part_rank") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return in_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _place(rows), schema)
