"""Operators over the functions of a code corpus: hashes, duplicates, calls and their targets, dependencies, classes.

All take symbols (path, name, base_name, start, end, type) and call sites (path, line_no, callee, call_type) as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .code import bodies, code_lines, tight_structure
from .graph import ancestors
from .ranges import containing

# Names that run without a caller, and how they begin.
ENTRY_NAMES = "main init setup teardown run start stop handler default constructor".split()
ENTRY_PREFIXES = "test handle on do get set render use".split()
#: Parents of a class, by the shape of its declaration: group 1 is the child, group 2 the parents, comma-separated.
INHERITANCE = [
    r"^\s*class\s+(\w+)\s*\(\s*([^)]+?)\s*\)\s*:",
    r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)\s*:\s*([^:{][^{]*?)\s*\{",
    r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|partial)\s+)*class\s+(\w+)\s+extends\s+(\w+)",
    r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial)\s+)*class\s+(\w+)\s+(?:extends\s+\w+\s+)?implements\s+([^{]+?)\s*(?:\{|$)",
    r"^\s*class\s+(\w+)\s*<\s*(\w+)",
    r"^\s*@interface\s+(\w+)\s*:\s*(\w+)",
]


def contained(found: DataFrame) -> DataFrame:
    """Symbols with container (the innermost other symbol of the file around them) and class_name (the innermost class)."""
    a, b = found.alias("a"), found.select("path", F.col("name").alias("o_name"), F.col("base_name").alias("o_base"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("type").alias("o_type")).alias("b")
    around = (F.col("a.path") == F.col("b.path")) & (F.col("o_start") <= F.col("a.start")) & (F.col("o_end") >= F.col("a.end")) & ((F.col("o_start") < F.col("a.start")) | (F.col("o_end") > F.col("a.end")))
    size = F.struct(F.col("o_end") - F.col("o_start"), -F.col("o_start"), "o_name")
    j = a.join(b, around, "left").groupBy(*[F.col(f"a.{c}").alias(c) for c in found.columns])
    return j.agg(F.min_by("o_name", F.when(F.col("o_name").isNotNull(), size)).alias("container"), F.min_by("o_base", F.when(F.col("o_type") == "class", size)).alias("class_name"))


def hashed(corpus: DataFrame, found: DataFrame, least_lines: int = 3) -> DataFrame:
    """Functions of least_lines or more lines with body_hash, struct_hash, and tight_hash where they have enough control flow
    and code lines."""
    own = bodies(corpus, found.where("type <> 'class'")).where(F.col("lines") >= least_lines)
    tight = F.when(code_lines(F.col("body")) >= least_lines, F.sha1(tight_structure(F.col("body"))))
    return own.withColumn("tight_hash", tight).withColumn("key", F.concat_ws("@", "path", "name"))


def exact_groups(h: DataFrame) -> DataFrame:
    """Functions of one body: n, lines, waste = (n - 1) * lines, and the first key."""
    g = h.groupBy("body_hash").agg(F.count("*").alias("n"), F.max("lines").alias("lines"), F.min("key").alias("first_key")).where("n > 1")
    return g.select("first_key", "n", "lines", ((F.col("n") - 1) * F.col("lines")).alias("waste"))


def alike_groups(h: DataFrame, by: str) -> DataFrame:
    """Functions of one structure (by = struct_hash or tight_hash) with more than one body; waste grows with log2 of the lines."""
    g = h.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("body_hash").alias("bodies"), F.max("lines").alias("lines"), F.min("key").alias("first_key"))
    waste = F.floor((F.col("n") - 1) * F.col("lines") * F.log2(F.greatest(F.col("lines"), F.lit(2))))
    return g.where("n > 1 AND bodies > 1").select("first_key", "n", "bodies", "lines", waste.alias("waste"))


def near_groups(h: DataFrame) -> DataFrame:
    """Functions of one bare name and length with more than one body."""
    g = h.groupBy("base_name", "lines").agg(F.count("*").alias("n"), F.count_distinct("body_hash").alias("bodies")).where("n > 1 AND bodies > 1")
    return g.withColumn("weight", F.col("n") * F.col("lines"))


def canonical(h: DataFrame) -> DataFrame:
    """Each copy with the canonical function of its body: the one of the shortest key, then the first."""
    w = Window.partitionBy("body_hash")
    first = F.min_by("key", F.struct(F.length("key"), "key")).over(w)
    return h.select("key", first.alias("canonical"), F.count("*").over(w).alias("copies")).where("copies > 1")


def call_counts(sites: DataFrame) -> DataFrame:
    """(callee, calls, files) by bare name."""
    return sites.groupBy("callee").agg(F.count("*").alias("calls"), F.count_distinct("path").alias("files"))


def with_calls(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Functions with lines, the calls of their bare name (0 without any), and how many definitions share the name."""
    own = found.where("type <> 'class'").withColumn("lines", F.col("end") - F.col("start") + 1)
    counts = call_counts(sites).select(F.col("callee").alias("base_name"), "calls")
    names = own.groupBy("base_name").agg(F.count("*").alias("definitions"))
    return own.join(counts, "base_name", "left").join(names, "base_name").withColumn("calls", F.coalesce("calls", F.lit(0)))


def hotspots(c: DataFrame) -> DataFrame:
    """Calls times log2 of the lines, of functions of two lines or more that are called."""
    return c.where("lines >= 2 AND calls > 0").withColumn("score", F.col("calls") * F.log2("lines"))


def domain_hotspots(c: DataFrame) -> DataFrame:
    """Calls times the root of the lines over the root of the name's definitions, of functions of five lines or more."""
    return c.where("lines >= 5 AND calls >= 1").withColumn("score", F.col("calls") * F.sqrt(F.greatest("lines", F.lit(5))) / F.sqrt("definitions"))


def class_hotspots(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Classes by the calls of their methods' names times log2 of the methods' lines, over the root of the classes of the name."""
    inside = contained(found)
    classes = inside.where("type = 'class'").select("path", F.col("base_name").alias("class_name"), (F.col("end") - F.col("start") + 1).alias("own_lines"))
    counts = call_counts(sites).select(F.col("callee").alias("base_name"), "calls")
    m = inside.where("type <> 'class' AND class_name IS NOT NULL").join(counts, "base_name", "left")
    m = m.groupBy("path", "class_name").agg(F.count("*").alias("methods"), F.sum(F.col("end") - F.col("start") + 1).alias("method_lines"), F.sum(F.coalesce("calls", F.lit(0))).alias("calls"))
    names = classes.groupBy("class_name").agg(F.count("*").alias("classes"))
    j = classes.join(m, ["path", "class_name"], "left").join(names, "class_name").withColumn("calls", F.coalesce("calls", F.lit(0)))
    lines = F.coalesce("method_lines", "own_lines")
    score = F.when((F.col("calls") > 0) & (lines > 0), F.col("calls") * F.log2(lines) / F.sqrt("classes")).otherwise(F.lit(0.0))
    return j.select("path", "class_name", F.coalesce("methods", F.lit(0)).alias("methods"), "calls", score.alias("score"))


def entry_points(c: DataFrame, most_calls: int = 0) -> DataFrame:
    """Functions of three lines or more that nothing, or little, calls."""
    return c.where((F.col("lines") >= 3) & (F.col("calls") <= most_calls))


def looks_like_entry(path: Column, base_name: Column) -> Column:
    """Names and paths that a caller outside the corpus is expected for."""
    name = F.lower(base_name)
    begins = F.lit(False)
    for p in ENTRY_PREFIXES:
        begins = begins | (name.startswith(p) & (F.length(name) > len(p)))
    page = path.rlike(r"(?i)\.[tj]sx$") & base_name.rlike("^[A-Z]") & ~base_name.rlike("^[A-Z]+$")
    return F.lower(path).rlike("test|spec") | name.isin(ENTRY_NAMES) | begins | page


def gaps(c: DataFrame) -> DataFrame:
    """Entry points that look like none: code that may be dead."""
    return entry_points(c).where(~looks_like_entry(F.col("path"), F.col("base_name")))


def inheritance(corpus: DataFrame) -> DataFrame:
    """(child, parent) of class declarations, access words and type arguments removed."""
    lines = corpus.select("path", F.explode(F.split("content", "\n", -1)).alias("line"))
    hits = [F.when(F.regexp_extract("line", p, 1) != "", F.struct(F.regexp_extract("line", p, 1).alias("child"), F.regexp_extract("line", p, 2).alias("parents"))) for p in INHERITANCE]
    each = lines.select("path", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("path", "h.child", F.explode(F.split("h.parents", r"\s*,\s*")).alias("raw"))
    parent = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\b(public|private|protected|virtual)\b", ""), r"<.*|\(.*|.*=.*", ""))
    return each.select("path", "child", F.element_at(F.split(parent, r"::|\."), -1).alias("parent")).where("parent <> '' AND parent <> child").distinct()


def resolved_calls(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Call sites of known names with their caller and target: path, line_no, callee, caller, target_path, target,
    candidates (left after the rule that decided) and rule.

    Candidates are the definitions of the bare name. A rule that leaves any ends the search: the caller's own class, for
    calls on itself or within it; the caller's file; then the path nearest to the caller's, by leading folders. Several
    left by the last are an ambiguous call, told by candidates, and go to the first path.
    """
    inside = contained(found)
    ranges = found.where("type <> 'class'").select("path", F.col("name").alias("caller"), "start", "end")
    known = sites.join(found.select(F.col("base_name").alias("callee")).distinct(), "callee", "left_semi")
    at = containing(known, ranges, ["path"], "line_no", "start", "end", "caller", innermost=True)
    classes = inside.select("path", F.col("name").alias("caller"), F.col("class_name").alias("caller_class"))
    at = at.join(classes, ["path", "caller"], "left")
    targets = inside.select(F.col("base_name").alias("callee"), F.col("path").alias("target_path"), F.col("name").alias("target"), F.col("class_name").alias("target_class"), F.col("start").alias("target_start"))
    j = at.join(targets, "callee")
    parts = lambda c: F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0)))
    same = F.aggregate(F.arrays_zip(parts("path").alias("x"), parts("target_path").alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct((s["n"] + F.when(s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")))["n"]
    own_class = (F.col("caller_class") == F.col("target_class")) & (F.col("path") == F.col("target_path"))
    rank = F.when(F.coalesce(own_class, F.lit(False)), F.lit(1_000_002)).when(F.col("path") == F.col("target_path"), F.lit(1_000_001)).otherwise(same)
    j = j.withColumn("rank", rank)
    key = ["path", "line_no", "callee", "call_type", "caller"]
    w = Window.partitionBy(*key)
    best = j.withColumn("top", F.max("rank").over(w)).where("rank = top")
    out = best.groupBy(*key).agg(F.min(F.struct("target_path", "target_start", "target")).alias("t"), F.count_distinct("target_path", "target_start").alias("candidates"), F.first("rank").alias("rank"))
    rule = F.when(F.col("rank") == 1_000_002, "class").when(F.col("rank") == 1_000_001, "file").otherwise("path")
    return out.select(*key, F.col("t.target_path").alias("target_path"), F.col("t.target").alias("target"), "candidates", rule.alias("rule"))


def file_edges(resolved: DataFrame) -> DataFrame:
    """(path, target_path, calls) between files; calls within a file are no dependency."""
    return resolved.where("path <> target_path").groupBy("path", "target_path").agg(F.count("*").alias("calls"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) of functions, as path@name."""
    key = lambda p, n: F.concat_ws("@", p, n)
    return resolved.where("caller IS NOT NULL").select(key("path", "caller").alias("src"), key("target_path", "target").alias("dst")).distinct()


def hot_folders(scored: DataFrame, least: float = 1.0) -> DataFrame:
    """(folder, score, functions) of every folder above a hotspot. A folder is dropped where the one above it is there with a
    score less than `least` away: it says nothing that the other does not."""
    each = scored.withColumn("folder", F.explode(ancestors(F.col("path")))).groupBy("folder").agg(F.sum("score").alias("score"), F.count("*").alias("functions"))
    above = each.select(F.col("folder").alias("above"), F.col("score").alias("above_score"))
    j = each.withColumn("above", F.regexp_extract("folder", r"^(.*)/[^/]+$", 1)).join(above, "above", "left")
    return j.where(F.col("above_score").isNull() | (F.abs(F.col("above_score") - F.col("score")) >= least)).select("folder", "score", "functions")


def fallback_containing(corpus: DataFrame, points: DataFrame, header: str) -> DataFrame:
    """points(path, line_no) with the name of the nearest line at or before them that is shaped like a definition (group 1 of
    header), for files without symbols."""
    lines = corpus.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), F.regexp_extract("line", header, 1).alias("name"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("name", F.last(F.when(F.col("name") != "", F.col("name")), ignorenulls=True).over(w))
    return points.join(named, ["path", "line_no"], "left")


def fan_out(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several results as one, with the index each is from."""
    out = None
    for name, df in corpora.items():
        own = df.select(F.lit(name).alias("index_name"), *df.columns)
        out = own if out is None else out.unionByName(own)
    return out


def function_digest(corpus: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row a function: lines, comments, strings, callers, callees and control flow."""
    own = bodies(corpus, found.where("type <> 'class'"))
    count = lambda p: F.regexp_count("body", F.lit(p)).cast("int")
    out = own.select("path", "name", "lines", count(r"(?m)(?:^|\s)(?://|#)[^\n]*$|/\*").alias("comments"), count(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'').alias("strings"))
    up = resolved.groupBy(F.col("target_path").alias("path"), F.col("target").alias("name")).agg(F.count("*").alias("called"))
    down = resolved.groupBy("path", F.col("caller").alias("name")).agg(F.count_distinct("target_path", "target").alias("calls"))
    return out.join(up, ["path", "name"], "left").join(down, ["path", "name"], "left").withColumns({"called": F.coalesce("called", F.lit(0)), "calls": F.coalesce("calls", F.lit(0))})


def class_digest(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a class: methods, their lines, parents and children by name."""
    inside = contained(found)
    classes = inside.where("type = 'class'").select("path", F.col("base_name").alias("class_name"))
    m = inside.where("type <> 'class' AND class_name IS NOT NULL").groupBy("path", "class_name").agg(F.array_join(F.array_sort(F.collect_set("base_name")), ",").alias("methods"), F.sum(F.col("end") - F.col("start") + 1).alias("method_lines"))
    up = edges.groupBy(F.col("child").alias("class_name")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("parents"))
    down = edges.groupBy(F.col("parent").alias("class_name")).agg(F.array_join(F.array_sort(F.collect_set("child")), ",").alias("children"))
    return classes.join(m, ["path", "class_name"], "left").join(up, "class_name", "left").join(down, "class_name", "left").select("path", "class_name", "methods", "method_lines", "parents", "children")
