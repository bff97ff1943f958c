"""Corpora from directories, lists, globs, archives, captures and binaries."""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never part of a corpus.
SKIP = ["node_modules", ".git", "__pycache__", ".venv", "dist", "build"]
DEPTH = 5


def directory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content binary) of a tree, on any file system Spark reads; skipped folders are filtered by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.where(~F.col("path").rlike("/(" + "|".join(re.escape(s) for s in SKIP) + ")/")).select("path", "content")


def filelist(spark: SparkSession, path: str) -> DataFrame:
    """The files, folders or globs that a list names, one a line; `#` begins a comment. The list itself is small."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).collect()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([r[0].strip() for r in rows])
    return raw.select("path", "content")


def text(corpus: DataFrame) -> DataFrame:
    """(path, content string); bytes that are no UTF-8 are replaced."""
    return corpus.select("path", F.expr("try_validate_utf8(cast(content AS string))").alias("s"), "content").select("path", F.coalesce("s", F.decode("content", "ISO-8859-1")).alias("content"))


def expand(path: str, data: bytes, depth: int = 0):
    """(path, bytes) of what an archive holds, or of the file itself; archives in archives down to DEPTH."""
    name = path.lower()
    if depth < DEPTH:
        try:
            if data[:4] == b"PK\x03\x04":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in z.infolist():
                        if not i.is_dir() and not i.flag_bits & 1:
                            yield from expand(f"{path}!{i.filename}", z.read(i), depth + 1)
                return
            if data[:2] == b"\x1f\x8b":
                yield from expand(re.sub(r"\.t?gz$", "", path) + (".tar" if name.endswith(".tgz") else ""), gzip.decompress(data), depth + 1)
                return
            if data[257:262] == b"ustar":
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            yield from expand(f"{path}!{m.name}", t.extractfile(m).read(), depth + 1)
                return
            if name.endswith(".har"):
                for e in json.loads(data)["log"]["entries"]:
                    body = e.get("response", {}).get("content", {})
                    if body.get("text") is not None:
                        raw = base64.b64decode(body["text"]) if body.get("encoding") == "base64" else body["text"].encode()
                        yield re.sub(r"^[a-z]+://|[?#].*$", "", e["request"]["url"]), raw
                return
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, KeyError):
            pass  # what only looks like an archive is a file
    yield path, data


def _expand(batches):
    for batch in batches:
        for path, data in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            found = list(expand(path, data or b""))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([d for _, d in found], pa.binary())], names=["path", "content"])


def archives(corpus: DataFrame) -> DataFrame:
    """Archives replaced by what they hold."""
    return corpus.select("path", "content").mapInArrow(_expand, "path string, content binary")


def strings(corpus: DataFrame, least: int = 6) -> DataFrame:
    """(path, at, value): runs of printable ASCII of binary files, in column expressions alone."""
    latin = F.decode("content", "ISO-8859-1")
    return corpus.select("path", F.posexplode(F.regexp_extract_all(latin, F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))).alias("at", "value"))
