"""Base relations of a text corpus: files, lines, postings and identifier tokens, all lazily derived."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.session import in_batches, table


def files(spark: SparkSession, sf_dir: str, dedup: bool = False) -> DataFrame:
    """(path, folder, ext, content, doc_id), one row per document; with dedup, byte-identical ones once,
    under the smallest doc_id."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    out = docs.select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("folder"),
        F.col("lang").alias("ext"),
        F.col("text").alias("content"),
        "doc_id",
    )
    if not dedup:
        return out
    # the digest is combined map-side, so copies of one text do not meet in one task with their contents
    first = docs.select(F.sha1("text").alias("digest"), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return out.join(first, "doc_id", "left_semi").select(*out.columns)


def lines(corpus: DataFrame) -> DataFrame:
    """(path, folder, ext, line_no from 1, line); a trailing empty line is a line."""
    return corpus.select("path", "folder", "ext", "doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).select(
        "path", "folder", "ext", "doc_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def norm_line(line: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def postings(corpus: DataFrame, least_chars: int = 4, most_files: int = 50) -> DataFrame:
    """(norm_line, n_files, n_lines, first_path) of normalised lines that are long enough and not in too many files."""
    rows = lines(corpus).select(norm_line(F.col("line")).alias("norm_line"), "path").where(F.length("norm_line") >= least_chars)
    per_file = rows.groupBy("norm_line", "path").agg(F.count("*").alias("n"))
    out = per_file.groupBy("norm_line").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.min("path").alias("first_path"))
    return out.where(F.col("n_files") <= most_files)


def tokens(corpus: DataFrame, pattern: str = r"[A-Za-z_][A-Za-z0-9_]*") -> DataFrame:
    """(path, folder, ext, token), one row per occurrence."""
    return corpus.select("path", "folder", "ext", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("token"))


#: Bytes of a text that are cut into identifiers at once.
STRETCH = 1 << 20
#: Entries that a worker combines before it hands them on.
HELD = 1 << 20
#: Paths of several rows whose texts are moved to one task by themselves; with more of them all texts are moved.
SHARED_PATHS = 10_000
#: Rows of one Arrow batch on its way from Python.
OUT_ROWS = 1 << 16

_APART = bytes(c if chr(c).isascii() and (chr(c).isalnum() or c == 95) else 32 for c in range(256))


def whole_paths(corpus: DataFrame) -> DataFrame:
    """(path, folder, content) with all rows of a path next to each other in one task. Where paths are unique, as they
    should be, nothing moves: only the texts of paths that several rows share are shuffled."""
    rows = corpus.select("path", "folder", "content")
    shared = [r.path for r in rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path").limit(SHARED_PATHS + 1).collect()]
    if not shared:
        return rows
    together = lambda df: df.repartition("path").sortWithinPartitions("path")
    if len(shared) > SHARED_PATHS:
        return together(rows)
    named = F.broadcast(corpus.sparkSession.createDataFrame([(p,) for p in shared], "path string"))
    return rows.join(named, "path", "left_anti").unionByName(together(rows.join(named, "path", "left_semi")))


def _identifiers(batches):
    """(path, folder, count of each identifier) of each run of rows of one path; its folder is the first that is not null."""

    def cut(found: Counter) -> Counter:
        # a word that begins with digits holds an identifier behind them
        for w in [w for w in found if w < b":"]:
            n = found.pop(w)
            if w := w.lstrip(b"0123456789"):
                found[w] += n
        return found

    path, folder, found = None, None, Counter()
    for b in batches:
        for p, f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if p != path:
                if path is not None:
                    yield path, folder, cut(found)
                path, folder, found = p, None, Counter()
            folder = f if folder is None else folder
            words, at = text.as_py().translate(_APART), 0
            while at < len(words):
                end = words.find(b" ", at + STRETCH)
                end = len(words) if end < 0 else end
                found.update(words[at:end].split())
                at = end
    if path is not None:
        yield path, folder, cut(found)


def _in_bytes(corpus: DataFrame) -> DataFrame:
    return corpus.select("path", "folder", F.col("content").cast("binary").alias("content"))


def token_tallies(corpus: DataFrame) -> DataFrame:
    """(folder, token, files, uses): counts of identifiers, combined within a task and to be summed by the caller. A run of
    rows of one path is a file; pass whole_paths(corpus) where that matters. A task's state is bounded by HELD."""
    schema = pa.schema([("folder", pa.string()), ("token", pa.string()), ("files", pa.int64()), ("uses", pa.int64())])

    def shown(held):
        for folder, (files_of, uses) in held.items():
            for k in range(0, len(names := list(files_of)), OUT_ROWS):
                part = names[k : k + OUT_ROWS]
                columns = [pa.array([folder] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([files_of[w] for w in part], pa.int64()), pa.array([uses[w] for w in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        held, size = {}, 0
        for _, folder, found in _identifiers(batches):
            files_of, uses = held.setdefault(folder, (Counter(), {}))
            size -= len(files_of)
            files_of.update(found.keys())
            size += len(files_of)
            for w, n in found.items():
                uses[w] = uses.get(w, 0) + n
            if size >= HELD:
                yield from shown(held)
                held, size = {}, 0
        yield from shown(held)

    return in_batches(_in_bytes(corpus), run, "folder string, token string, files long, uses long")


def token_places(corpus: DataFrame, best: int | None = None, few: int | None = None) -> DataFrame:
    """(token, files, places): how many of a block of files hold an identifier, and where, as structs (less, path) in that
    order, `less` being the uses there below zero. A block is what a task holds of HELD files' entries. With `best` only so
    many places of each token and block, the first; with `few` none for tokens in more files of the block than that.
    Pass whole_paths(corpus), so that a path is in one block."""
    place = pa.struct([("less", pa.int64()), ("path", pa.string())])
    schema = pa.schema([("token", pa.string()), ("files", pa.int64()), ("places", pa.list_(place))])

    def shown(code, paths, codes, counts):
        if not code:
            return
        names = pa.array(list(code), pa.binary()).cast(pa.string())
        of = np.repeat(np.arange(len(paths)), [len(c) for c in codes])
        code, less = np.concatenate(codes), -np.concatenate(counts)
        alphabet = sorted(range(len(paths)), key=lambda k: paths[k].encode())
        rank = np.empty(len(paths), np.int64)
        rank[alphabet] = np.arange(len(paths))
        order = np.lexsort((rank[of], less, code))
        code, less, of = code[order], less[order], of[order]
        n = np.bincount(code)
        if best is not None or few is not None:
            within = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.repeat(n <= few, n) if few is not None else within < best
            less, of = less[keep], of[keep]
            listed = np.where(n <= few, n, 0) if few is not None else np.minimum(n, best)
        else:
            listed = n
        ends, paths = np.concatenate(([0], np.cumsum(listed))), pa.array(paths, pa.string())
        first = 0
        while first < len(n):
            last = max(first + 1, min(len(n), first + OUT_ROWS, int(np.searchsorted(ends, ends[first] + 4 * OUT_ROWS))))
            a, b = ends[first], ends[last]
            entries = pa.StructArray.from_arrays([pa.array(less[a:b]), paths.take(pa.array(of[a:b]))], fields=list(place))
            lists = pa.ListArray.from_arrays(pa.array(ends[first : last + 1] - a, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([names.slice(first, last - first), pa.array(n[first:last]), lists.cast(schema.field("places").type)], schema=schema)
            first = last

    def run(batches):
        code, paths, codes, counts, size = {}, [], [], [], 0
        for path, _, found in _identifiers(batches):
            paths.append(path)
            codes.append(np.array([code.setdefault(w, len(code)) for w in found], np.int64))
            counts.append(np.fromiter(found.values(), np.int64, len(found)))
            size += len(found) + 1
            if size >= HELD:
                yield from shown(code, paths, codes, counts)
                code, paths, codes, counts, size = {}, [], [], [], 0
        yield from shown(code, paths, codes, counts)

    return in_batches(_in_bytes(corpus), run, "token string, files long, places array<struct<less: long, path: string>>")


def token_kinds(corpus: DataFrame) -> DataFrame:
    """(path, kinds): how many different identifiers a file holds. Pass whole_paths(corpus), so that a path is one file."""

    def run(batches):
        paths, kinds = [], []
        for path, _, found in _identifiers(batches):
            paths.append(path)
            kinds.append(len(found))
            if len(paths) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.int64())], names=["path", "kinds"])
                paths, kinds = [], []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.int64())], names=["path", "kinds"])

    return in_batches(_in_bytes(corpus), run, "path string, kinds long")


def contains(column: Column, term: str) -> Column:
    """Case-insensitive substring test; no regular expression, so no escapes."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def context(rows: DataFrame, partition: list[str], order: str, text: str, around: int) -> DataFrame:
    """Adds `context`: the text of the rows within `around` places, joined by newlines."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))
