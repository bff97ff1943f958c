"""Dependency manifests and lockfiles as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON = "dependencies map<string,string>, devDependencies map<string,string>"
LOCK = "packages map<string, struct<version:string, dependencies:map<string,string>>>"
COMPOSER = "packages array<struct<name:string, version:string, require:map<string,string>>>, `packages-dev` array<struct<name:string, version:string, require:map<string,string>>>"
PIPENV = "`default` map<string, struct<version:string>>, develop map<string, struct<version:string>>"
# Requirements of a platform, which are no packages.
PLATFORM = "(?i)^(?:php|hhvm|ext-|lib-|composer-)"


def declared(corpus: DataFrame) -> DataFrame:
    """(path, name, version, dev) from package.json, requirements and go.mod files of (path, content)."""
    js = corpus.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("content", JSON))
    both = [js.select("path", F.explode(f"j.{k}").alias("name", "version"), F.lit(dev).alias("dev")) for k, dev in (("dependencies", False), ("devDependencies", True))]
    py = corpus.where(F.col("path").rlike(r"(^|/)requirements[\w-]*\.txt$")).select("path", F.explode(F.split("content", "\n")).alias("line"))
    py = py.where(F.trim("line").rlike("^[A-Za-z]")).select("path", F.regexp_extract("line", r"^\s*([A-Za-z][\w.-]*)", 1).alias("name"), F.nullif(F.regexp_extract("line", r"[=<>~!]=?\s*([\w.*]+)", 1), F.lit("")).alias("version"), F.lit(False).alias("dev"))
    go = corpus.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("path", F.explode(F.split("content", "\n")).alias("line"))
    go = go.where(F.col("line").rlike(r"^\s*(?:require\s+)?[\w.-]+\.[a-z]+/\S+\s+v")).select("path", F.regexp_extract("line", r"([\w.-]+\.[a-z]+/\S+)\s+v", 1).alias("name"), F.regexp_extract("line", r"\s(v\S+)", 1).alias("version"), F.lit(False).alias("dev"))
    return both[0].union(both[1]).union(py).union(go)


def _npm(corpus: DataFrame) -> DataFrame:
    js = corpus.where(F.col("path").rlike(r"(?i)(^|/)(package-lock|npm-shrinkwrap)\.json$")).withColumn("j", F.from_json("content", LOCK))
    own = js.select("path", F.explode("j.packages").alias("at", "p"))
    return own.select("path", F.regexp_replace("at", r"^.*node_modules/", "").alias("package"), "p.version", F.explode_outer(F.map_keys("p.dependencies")).alias("depends_on"))


def _composer(corpus: DataFrame) -> DataFrame:
    js = corpus.where(F.col("path").rlike(r"(?i)(^|/)composer\.lock$")).withColumn("j", F.from_json("content", COMPOSER))
    own = js.select("path", F.explode(F.concat(F.coalesce("j.packages", F.array()), F.coalesce(F.col("j.`packages-dev`"), F.array()))).alias("p")).where("p.name IS NOT NULL")
    real = F.filter(F.map_keys("p.require"), lambda n: ~n.rlike(PLATFORM))
    return own.select("path", F.col("p.name").alias("package"), "p.version", F.explode_outer(real).alias("depends_on"))


def _pipenv(corpus: DataFrame) -> DataFrame:
    js = corpus.where(F.col("path").rlike(r"(?i)(^|/)pipfile\.lock$")).withColumn("j", F.from_json("content", PIPENV))
    both = [js.select("path", F.explode(f"j.{k}").alias("package", "p")) for k in ("`default`", "develop")]
    return both[0].union(both[1]).select("path", "package", F.regexp_replace("p.version", "^==", "").alias("version"), F.lit(None).cast("string").alias("depends_on"))


def _go_sums(corpus: DataFrame) -> DataFrame:
    line = corpus.where(F.col("path").rlike(r"(?i)(^|/)go\.sum$")).select("path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    sums = line.where(F.col("line").rlike(r"^\S+\s+v\S+\s+h1:") & ~F.col("line").rlike(r"^\S+\s+v\S+/go\.mod\s"))
    at = lambda k: F.regexp_extract("line", r"^(\S+)\s+(v\S+)\s+h1:", k)
    return sums.select("path", at(1).alias("package"), at(2).alias("version"), F.lit(None).cast("string").alias("depends_on")).distinct()


def _blocks(corpus: DataFrame, file: str, dependencies: str, item: str) -> DataFrame:
    """Packages of a lockfile in [[package]] blocks; the first group of `dependencies` holds the items."""
    block = corpus.where(F.col("path").rlike(file)).select("path", F.explode(F.slice(F.split("content", r"(?m)^\s*\[\[package\]\]\s*$"), F.lit(2), F.lit(1 << 30))).alias("b"))
    value = lambda k: F.nullif(F.regexp_extract("b", rf'(?m)^\s*{k}\s*=\s*"([^"]+)"', 1), F.lit(""))
    needs = F.regexp_extract_all(F.regexp_extract("b", dependencies, 1), F.lit(item), F.lit(1))
    return block.select("path", value("name").alias("package"), value("version").alias("version"), F.explode_outer(needs).alias("depends_on")).where("package IS NOT NULL")


def locked(corpus: DataFrame) -> DataFrame:
    """(path, package, version, depends_on) of lockfiles: npm (its root package has an empty name), Composer, Pipenv, Go sums,
    Cargo and Poetry. Null depends_on: none are recorded. A file that cannot be read as its kind has no rows."""
    cargo = _blocks(corpus, r"(?i)(^|/)cargo\.lock$", r"(?ms)^\s*dependencies\s*=\s*\[(.*?)\]", r'"([^"\s]+)[^"]*"')
    poetry = _blocks(corpus, r"(?i)(^|/)poetry\.lock$", r"(?ms)^\s*\[package\.dependencies\]\s*$(.*?)(?=^\s*\[|\z)", r'(?m)^\s*"?([A-Za-z0-9_.-]+)"?\s*=')
    out = _npm(corpus)
    for kind in (_composer(corpus), _pipenv(corpus), _go_sums(corpus), cargo, poetry):
        out = out.union(kind)
    return out


def chains(edges: DataFrame, depth: int = 40) -> DataFrame:
    """(package, chain): every cycle-free chain from the root of (package, depends_on), down to depth."""
    e = edges.where("depends_on IS NOT NULL").select(F.col("package").alias("src"), F.col("depends_on").alias("dst")).distinct()
    level = e.where("src = ''").select(F.col("dst").alias("package"), F.array("dst").alias("chain"))
    out = level
    for _ in range(depth - 1):
        level = level.join(e, F.col("package") == e.src).where(~F.array_contains("chain", F.col("dst"))).select(F.col("dst").alias("package"), F.concat("chain", F.array("dst")).alias("chain"))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def bom(declared_: DataFrame, imported: DataFrame, locked_: DataFrame) -> DataFrame:
    """(name, state): declared without an import, imported without a declaration (transitive if locked), and declared
    without a lock."""
    d = declared_.groupBy("name").agg(F.min("dev").alias("dev")).withColumn("d", F.lit(True))
    i = imported.select("name").distinct().withColumn("i", F.lit(True))
    k = locked_.select(F.col("package").alias("name")).where("name <> ''").distinct().withColumn("k", F.lit(True))
    j = d.join(i, "name", "full").join(k, "name", "full").select("name", F.coalesce("dev", F.lit(False)).alias("dev"), *[F.coalesce(c, F.lit(False)).alias(c) for c in "dik"])
    states = F.filter(
        F.array(
            F.when(F.col("d") & ~F.col("i"), F.when(F.col("dev"), "dev not imported").otherwise("not imported")),
            F.when(F.col("i") & ~F.col("d"), F.when(F.col("k"), "transitive").otherwise("absent")),
            F.when(F.col("d") & ~F.col("dev") & ~F.col("k"), "not locked"),
        ),
        lambda s: s.isNotNull(),
    )
    return j.select("name", F.explode(states).alias("state"))
