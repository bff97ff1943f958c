"""Packages, vendored subtrees and renames of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as fn
from stratalens.operators.corpus import tokens

# Files that make their folder a project of its own.
MANIFEST = r"(?i)^(?:setup[.]py|pyproject[.]toml|package[.]json|Cargo[.]toml|go[.]mod|composer[.]json|Gemfile)$"


def _slashed():
    return F.replace("path", F.lit("\\"), F.lit("/"))


def packages(corpus: DataFrame) -> DataFrame:
    """(dir, dotted, init_file) of every folder of Python files; one without an init file is implicit, its init_file null.
    Of several init files the last by name counts. Null paths are in no package."""
    py = corpus.select("path", _slashed().alias("p")).where(F.col("p").rlike(r"(?i)\.pyi?$"))
    own = py.select(F.regexp_extract("p", r"^(.*)/[^/]*$", 1).alias("dir"), F.when(F.col("p").rlike(r"(?i)(^|/)__init__\.pyi?$"), F.col("path")).alias("init"))
    found = own.groupBy("dir").agg(F.max("init").alias("init_file"))
    return found.select("dir", F.array_join(F.filter(F.split("dir", "/"), lambda x: x != ""), ".").alias("dotted"), "init_file")


def vendored(corpus: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(root, holder, holder_files, headered, files) of folders below the top that hold a manifest, at least `least` files
    with a notice, and one holder for at least `share` of these; ties go to the first name. A folder that holds every
    file is the project itself. Files meet the roots by their ancestor folders, counted by (root, holder) first."""
    f = corpus.select(_slashed().alias("p"), fn.header_holder(F.col("content")).alias("holder")).where("p IS NOT NULL").withColumn("parts", F.split("p", "/"))
    roots = f.where((F.size("parts") > 1) & F.element_at("parts", -1).rlike(MANIFEST)).select(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("root")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    under = f.where(F.size("parts") > 1).select("holder", F.explode(above).alias("root")).join(roots, "root")
    per = under.groupBy("root", "holder").agg(F.count("*").alias("n"))
    named = F.col("holder").isNotNull()
    top = F.min(F.when(named, F.struct(-F.col("n"), "holder"))).alias("top")
    g = per.groupBy("root").agg(F.sum("n").alias("files"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("headered"), top)
    g = g.crossJoin(f.agg(F.count("*").alias("all_files"))).where(f"files < all_files AND headered >= {least}")
    return g.select("root", F.col("top.holder").alias("holder"), (-F.col("top.col1")).alias("holder_files"), "headered", "files").where(F.col("holder_files") >= share * F.col("headered"))


def display(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, display): the rename of a name, else that of its class before the last `::`, else the name. One rename a name is expected."""
    cut = r"^(.*)::(.*)$"
    n = names.select("name", F.when(F.col("name").rlike(cut), F.regexp_extract("name", cut, 1)).alias("cls"), F.regexp_extract("name", cut, 2).alias("leaf"))
    whole = renames.select(F.col("name"), F.col("display").alias("whole"))
    part = renames.select(F.col("name").alias("cls"), F.col("display").alias("part"))
    j = n.join(whole, "name", "left").join(part, "cls", "left")
    return j.select("name", F.coalesce("whole", F.concat("part", F.lit("::"), "leaf"), "name").alias("display"))


def renamed_hits(corpus: DataFrame, renames: DataFrame, pattern: str) -> DataFrame:
    """(path, token, uses) of the identifiers whose display name matches the pattern. Originals meet the corpus's tokens
    in a join, so any number of them may match."""
    wanted = renames.where(F.col("display").rlike(pattern)).select(F.col("name").alias("token")).distinct()
    return tokens(corpus).join(wanted, "token", "left_semi").groupBy("path", "token").agg(F.count("*").alias("uses"))


def profile(symbols: DataFrame, extensions: int = 6, folders: int = 10) -> DataFrame:
    """(kind, value, n): the extensions and the folders (their last two parts, for paths of more than two) with the most
    symbols; ties go by name. Within an archive the path inside counts. A report of the top few."""
    p = F.element_at(F.split("path", "!"), -1)
    ext = F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)
    folder = F.regexp_extract(p, r"^(?:.*/)?([^/]*/[^/]*)/[^/]*$", 1)
    top = lambda c, kind, k: symbols.groupBy(c.alias("value")).agg(F.count("*").alias("n")).where("value <> ''").orderBy(F.desc("n"), "value").limit(k).select(F.lit(kind).alias("kind"), "value", "n")
    return top(ext, "extension", extensions).union(top(folder, "folder", folders))
