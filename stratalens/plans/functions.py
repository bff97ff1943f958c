"""Queries over the functions of a project. The driver's tables hold no source code, so the project is a fixture: its files,
its symbols and its call sites are stated here, once for the engine and once for SQL, which computes all else by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators import functions as ops
from stratalens.operators.code import call_sites, symbols
from stratalens.plans.registry import query

# The project, and the symbols and call sites that it has, read off by hand.
PROJECT = {
    "core/shape.py": "class Shape:\n    def area(self):\n        return 0\n\n    def describe(self):\n        text = label(self)\n        return text\n\n\nclass Square(Shape):\n    def area(self):\n        side = self.side\n        return side * side\n\n    def describe(self):\n        self.area()\n        return label(self)\n\n\ndef label(item):\n    name = item.name\n    return name.upper()\n\n\ndef report(items):\n    out = []\n    for item in items:\n        out.append(label(item))\n    return out\n",
    "core/copy.py": "def label(item):\n    name = item.name\n    return name.upper()\n\n\ndef listing(rows):\n    acc = []\n    for row in rows:\n        acc.append(label(row))\n    return acc\n",
    "native/sum.c": '#include "sum.h"\n\nstatic int add(int a, int b) {\n  return a + b;\n}\n\nint sum(int *xs, int n) {\n  int s = 0;\n  for (int i = 0; i < n; i++) {\n    s = add(s, xs[i]);\n  }\n  return s;\n}\n\nint main(void) {\n  int xs[2];\n  /* sum(xs, 1) */\n  return sum(xs, 2);\n}\n',
    "web/draw.js": "export function draw(model) {\n  if (!model) {\n    return null;\n  }\n  return paint(model);\n}\n\nfunction paint(model) {\n  return model;\n}\n",
    "web/view.js": 'import { draw } from "./draw.js";\n\nclass View {\n  render(model) {\n    draw(model);\n    return model;\n  }\n}\n\nclass ListView extends View {\n  render(model) {\n    draw(model);\n    draw(model.items);\n    return model;\n  }\n}\n\nfunction main() {\n  const v = new ListView();\n  v.render("draw(x)");\n}\n',
    "tests/test_shape.py": "from core.shape import label\n\n\ndef test_label():\n    item = object()\n    assert label(item) is None\n",
}
SYMBOLS = [
    ("core/copy.py", "label", "label", 1, 3, "function"),
    ("core/copy.py", "listing", "listing", 6, 10, "function"),
    ("core/shape.py", "Shape", "Shape", 1, 7, "class"),
    ("core/shape.py", "Shape.area", "area", 2, 3, "method"),
    ("core/shape.py", "Shape.describe", "describe", 5, 7, "method"),
    ("core/shape.py", "Square", "Square", 10, 17, "class"),
    ("core/shape.py", "Square.area", "area", 11, 13, "method"),
    ("core/shape.py", "Square.describe", "describe", 15, 17, "method"),
    ("core/shape.py", "label", "label", 20, 22, "function"),
    ("core/shape.py", "report", "report", 25, 29, "function"),
    ("native/sum.c", "add", "add", 3, 5, "function"),
    ("native/sum.c", "main", "main", 15, 19, "function"),
    ("native/sum.c", "sum", "sum", 7, 13, "function"),
    ("tests/test_shape.py", "test_label", "test_label", 4, 6, "function"),
    ("web/draw.js", "draw", "draw", 1, 6, "function"),
    ("web/draw.js", "paint", "paint", 8, 10, "function"),
    ("web/view.js", "ListView", "ListView", 10, 16, "class"),
    ("web/view.js", "View", "View", 3, 8, "class"),
    ("web/view.js", "main", "main", 18, 21, "function"),
    ("web/view.js", "render", "render", 4, 7, "function"),
    ("web/view.js", "render@2", "render", 11, 15, "function"),
]
SITES = [
    ("core/copy.py", 3, "upper", "member"),
    ("core/copy.py", 9, "append", "member"),
    ("core/copy.py", 9, "label", "simple"),
    ("core/shape.py", 6, "label", "simple"),
    ("core/shape.py", 10, "Square", "simple"),
    ("core/shape.py", 16, "area", "member"),
    ("core/shape.py", 17, "label", "simple"),
    ("core/shape.py", 22, "upper", "member"),
    ("core/shape.py", 28, "append", "member"),
    ("core/shape.py", 28, "label", "simple"),
    ("native/sum.c", 10, "add", "simple"),
    ("native/sum.c", 18, "sum", "simple"),
    ("tests/test_shape.py", 5, "object", "simple"),
    ("tests/test_shape.py", 6, "label", "simple"),
    ("web/draw.js", 5, "paint", "simple"),
    ("web/view.js", 5, "draw", "simple"),
    ("web/view.js", 12, "draw", "simple"),
    ("web/view.js", 13, "draw", "simple"),
    ("web/view.js", 19, "ListView", "simple"),
    ("web/view.js", 20, "render", "member"),
]
#: The site at a class's own definition is none.
SITES = [s for s in SITES if s[:3] != ("core/shape.py", 10, "Square")]


def _values(rows) -> str:
    shown = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


SQL = f"""WITH src(path, content) AS (VALUES {_values(PROJECT.items())}), sym(path, name, base_name, s, e, type) AS (VALUES {_values(SYMBOLS)}),
 site(path, line_no, callee, call_type) AS (VALUES {_values(SITES)}),
 fn AS (SELECT *, e - s + 1 AS lines, path || '@' || name AS key FROM sym WHERE type <> 'class'),
 body AS (SELECT fn.*, array_to_string(string_split(content, chr(10))[s:e], chr(10)) AS text FROM fn JOIN src USING (path)),
 cnt AS (SELECT callee, count(*) AS calls FROM site GROUP BY callee),
 c AS (SELECT fn.*, coalesce(calls, 0) AS calls, count(*) OVER (PARTITION BY base_name) AS defs FROM fn LEFT JOIN cnt ON callee = base_name),
 around AS (SELECT a.path, a.name, arg_min(b.name, (b.e - b.s, -b.s)) AS container, arg_min(CASE WHEN b.type = 'class' THEN b.base_name END, CASE WHEN b.type = 'class' THEN b.e - b.s END) AS class_name
   FROM sym a LEFT JOIN sym b ON a.path = b.path AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e) GROUP BY 1, 2),
 known AS (SELECT * FROM site WHERE callee IN (SELECT base_name FROM sym)),
 called AS (SELECT k.*, (SELECT arg_min(f.name, f.e - f.s) FROM fn f WHERE f.path = k.path AND k.line_no BETWEEN f.s AND f.e) AS caller FROM known k),
 cand AS (SELECT q.path, q.line_no, q.callee, q.caller, t.path AS target_path, t.name AS target, t.s AS target_s,
   CASE WHEN x.class_name = y.class_name AND q.path = t.path THEN 1000002 WHEN q.path = t.path THEN 1000001
        ELSE CASE WHEN string_split(q.path, '/')[1] = string_split(t.path, '/')[1] THEN 1 ELSE 0 END END AS rank
   FROM called q JOIN sym t ON t.base_name = q.callee LEFT JOIN around x ON x.path = q.path AND x.name = q.caller LEFT JOIN around y ON y.path = t.path AND y.name = t.name),
 res AS (SELECT path, line_no, callee, caller, arg_min(target_path, (target_path, target_s)) AS target_path, arg_min(target, (target_path, target_s)) AS target, count(*) AS candidates,
   CASE max(rank) WHEN 1000002 THEN 'class' WHEN 1000001 THEN 'file' ELSE 'path' END AS rule
   FROM (SELECT *, max(rank) OVER (PARTITION BY path, line_no, callee, caller) AS top FROM cand) WHERE rank = top GROUP BY 1, 2, 3, 4),
 edge AS (SELECT DISTINCT path || '@' || caller AS src, target_path || '@' || target AS dst FROM res WHERE caller IS NOT NULL),
 inh(child, parent) AS (VALUES ('Square', 'Shape'), ('ListView', 'View'))
"""


def _project(spark):
    c = spark.createDataFrame(list(PROJECT.items()), "path string, content string")
    found = symbols(c)
    return c, found, call_sites(c, found)


def _calls(spark):
    _, found, sites = _project(spark)
    return ops.with_calls(found, sites)


def _resolved(spark):
    _, found, sites = _project(spark)
    return ops.resolved_calls(found, sites)


@query("project_symbols", f"{SQL} SELECT path, name, base_name, s::INT AS start, e::INT AS \"end\", type, container, class_name FROM sym JOIN around USING (path, name)")
def project_symbols(spark, sf_dir):
    """Definitions with the innermost one around them, and the innermost class."""
    return ops.contained(_project(spark)[1])


@query("project_calls", f"{SQL} SELECT path, line_no::INT AS line_no, callee, call_type FROM site")
def project_calls(spark, sf_dir):
    """Call sites, less comments, strings and definitions."""
    return _project(spark)[2]


@query("functions_by_name", f"{SQL} SELECT path, name, lines::INT AS lines, row_number() OVER (ORDER BY base_name, path, s) AS place FROM fn QUALIFY place <= 10")
def functions_by_name(spark, sf_dir):
    """The first ten functions by name: a list with a cap."""
    own = _calls(spark).orderBy("base_name", "path", "start").limit(10)
    place = F.row_number().over(ops.Window.orderBy("base_name", "path", "start"))
    return own.select("path", "name", "lines", place.cast("long").alias("place"))


@query("functions_by_size", f"{SQL} SELECT path, name, lines::INT AS lines FROM fn ORDER BY lines DESC, path, s LIMIT 5")
def functions_by_size(spark, sf_dir):
    """The five longest functions."""
    return _calls(spark).orderBy(F.desc("lines"), "path", "start").limit(5).select("path", "name", "lines")


@query("function_exact_dupes", f"{SQL} SELECT min(key) AS first_key, count(*) AS n, max(lines)::INT AS lines, ((count(*) - 1) * max(lines))::BIGINT AS waste FROM body WHERE lines >= 3 GROUP BY text HAVING count(*) > 1")
def function_exact_dupes(spark, sf_dir):
    """Functions of one body."""
    c, found, _ = _project(spark)
    return ops.exact_groups(ops.hashed(c, found))


@query("function_near_dupes", f"{SQL} SELECT base_name, lines::INT AS lines, count(*) AS n, count(DISTINCT text) AS bodies, (count(*) * lines)::BIGINT AS weight FROM body WHERE lines >= 3 GROUP BY base_name, lines HAVING count(DISTINCT text) > 1")
def function_near_dupes(spark, sf_dir):
    """Functions of one name and length, but not of one body."""
    c, found, _ = _project(spark)
    return ops.near_groups(ops.hashed(c, found))


WORDS = "(if|else|for|return|in|class|self|static|null)"
STRUCTURE_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d+\\b', '0', 'g'), '\\b([A-Za-z_]\\w*)', '<\\1>', 'g'), '<{WORDS}>', '\\1', 'g'), '\\s+', ' ', 'g'))"


@query(
    "function_struct_dupes",
    f"""{SQL}, st AS (SELECT *, regexp_replace({STRUCTURE_SQL}, '<\\w+>', '_', 'g') AS shape FROM body WHERE lines >= 3)
        SELECT min(key) AS first_key, count(*) AS n, count(DISTINCT text) AS bodies, max(lines)::INT AS lines, floor((count(*) - 1) * max(lines) * log2(greatest(max(lines), 2)))::BIGINT AS waste
        FROM st GROUP BY shape HAVING count(DISTINCT text) > 1""",
)
def function_struct_dupes(spark, sf_dir):
    """Functions of one structure and more than one body."""
    c, found, _ = _project(spark)
    return ops.alike_groups(ops.hashed(c, found), "struct_hash")


@query("canonical_functions", f"{SQL} SELECT key, first_value(key) OVER (PARTITION BY text ORDER BY length(key), key) AS canonical, count(*) OVER (PARTITION BY text) AS copies FROM body WHERE lines >= 3 QUALIFY copies > 1")
def canonical_functions(spark, sf_dir):
    """Copies with the canonical one of their body."""
    c, found, _ = _project(spark)
    return ops.canonical(ops.hashed(c, found))


@query("function_hotspots", f"{SQL} SELECT path, name, calls, round(calls * log2(lines), 6) AS score FROM c WHERE lines >= 2 AND calls > 0")
def function_hotspots(spark, sf_dir):
    """Calls times log2 of the lines."""
    return ops.hotspots(_calls(spark)).select("path", "name", "calls", F.round("score", 6).alias("score"))


@query("function_domain_hotspots", f"{SQL} SELECT path, name, calls, round(calls * sqrt(greatest(lines, 5)) / sqrt(defs), 6) AS score FROM c WHERE lines >= 5 AND calls >= 1")
def function_domain_hotspots(spark, sf_dir):
    """Calls times the root of the lines over the root of the definitions."""
    return ops.domain_hotspots(_calls(spark)).select("path", "name", "calls", F.round("score", 6).alias("score"))


@query(
    "project_class_hotspots",
    f"""{SQL}, m AS (SELECT c.path, class_name, count(*) AS methods, sum(lines) AS lines, sum(calls) AS calls FROM c JOIN around USING (path, name) WHERE class_name IS NOT NULL GROUP BY 1, 2)
        SELECT k.path, k.base_name AS class_name, coalesce(methods, 0) AS methods, coalesce(m.calls, 0)::BIGINT AS calls, round(CASE WHEN m.calls > 0 THEN m.calls * log2(m.lines) / sqrt(count(*) OVER (PARTITION BY k.base_name)) ELSE 0 END, 6) AS score
        FROM sym k LEFT JOIN m ON m.path = k.path AND m.class_name = k.base_name WHERE type = 'class'""",
)
def project_class_hotspots(spark, sf_dir):
    """Classes by the calls of their methods."""
    _, found, sites = _project(spark)
    return ops.class_hotspots(found, sites).withColumn("score", F.round("score", 6))


@query("project_entry_points", f"{SQL} SELECT path, name, lines::INT AS lines FROM c WHERE lines >= 3 AND calls = 0")
def project_entry_points(spark, sf_dir):
    """Functions that nothing calls."""
    return ops.entry_points(_calls(spark)).select("path", "name", "lines")


@query("project_gaps", f"{SQL} SELECT path, name, lines::INT AS lines FROM c WHERE lines >= 3 AND calls = 0 AND base_name NOT IN ('main') AND path NOT LIKE '%test%' AND base_name NOT LIKE 'render_%' AND base_name NOT LIKE 'do_%'")
def project_gaps(spark, sf_dir):
    """Entry points that look like none."""
    return ops.gaps(_calls(spark)).select("path", "name", "lines")


@query("inheritance_edges", f"{SQL} SELECT child, parent FROM inh")
def inheritance_edges(spark, sf_dir):
    """Classes and their parents, by declaration."""
    return ops.inheritance(_project(spark)[0]).select("child", "parent")


@query("resolved_calls", f"{SQL} SELECT path, line_no::INT AS line_no, callee, caller, target_path, target, candidates, rule FROM res")
def resolved_calls(spark, sf_dir):
    """Call sites with their caller and the definition that they mean."""
    return _resolved(spark).drop("call_type")


@query("project_file_deps", f"{SQL} SELECT path, target_path, count(*) AS calls FROM res WHERE path <> target_path GROUP BY 1, 2")
def project_file_deps(spark, sf_dir):
    """Calls between files."""
    return ops.file_edges(_resolved(spark))


@query(
    "project_call_tree",
    f"""{SQL.replace("WITH src", "WITH RECURSIVE src", 1)}, t AS (SELECT src AS root, src AS node, 0 AS depth FROM (SELECT DISTINCT src FROM edge) UNION SELECT root, dst, depth + 1 FROM t JOIN edge ON edge.src = node WHERE depth < 3)
        SELECT root, node, min(depth)::INT AS depth FROM t GROUP BY 1, 2""",
)
def project_call_tree(spark, sf_dir):
    """What each function reaches within three calls."""
    edges = ops.call_edges(_resolved(spark))
    from stratalens.operators.graph import expand

    return expand(edges, edges.select(F.col("src").alias("node")).distinct(), 3)


@query(
    "project_hot_folders",
    f"""{SQL}, h AS (SELECT path, calls * log2(lines) AS score FROM c WHERE lines >= 2 AND calls > 0)
        SELECT string_split(path, '/')[1] AS folder, round(sum(score), 6) AS score, count(*) AS functions FROM h GROUP BY 1""",
)
def project_hot_folders(spark, sf_dir):
    """Folders by the score of the functions below them."""
    return ops.hot_folders(ops.hotspots(_calls(spark))).select("folder", F.round("score", 6).alias("score"), "functions")


@query(
    "function_digests",
    f"""{SQL} SELECT path, name, lines::INT AS lines, (SELECT count(*) FROM res WHERE target_path = b.path AND target = b.name) AS called,
        (SELECT count(DISTINCT (target_path, target)) FROM res WHERE res.path = b.path AND res.caller = b.name) AS calls FROM body b""",
)
def function_digests(spark, sf_dir):
    """Functions with how often they are called and how many others they call."""
    c, found, sites = _project(spark)
    return ops.function_digest(c, found, ops.resolved_calls(found, sites)).select("path", "name", "lines", "called", "calls")


@query(
    "class_digests",
    f"""{SQL} SELECT k.path, k.base_name AS class_name, m.methods, m.method_lines, p.parents, d.children FROM sym k
        LEFT JOIN (SELECT fn.path, class_name, string_agg(DISTINCT base_name, ',' ORDER BY base_name) AS methods, sum(lines)::BIGINT AS method_lines FROM fn JOIN around USING (path, name) WHERE class_name IS NOT NULL GROUP BY 1, 2) m ON m.path = k.path AND m.class_name = k.base_name
        LEFT JOIN (SELECT child, string_agg(parent, ',') AS parents FROM inh GROUP BY 1) p ON p.child = k.base_name LEFT JOIN (SELECT parent, string_agg(child, ',') AS children FROM inh GROUP BY 1) d ON d.parent = k.base_name WHERE type = 'class'""",
)
def class_digests(spark, sf_dir):
    """Classes with their methods, parents and children."""
    c, found, _ = _project(spark)
    return ops.class_digest(found, ops.inheritance(c))


@query(
    "fallback_containers",
    f"""{SQL}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM src),
        d AS (SELECT path, line_no, regexp_extract(line, '^\\s*def\\s+(\\w+)', 1) AS name FROM l)
        SELECT s.path, s.line_no::INT AS line_no, (SELECT arg_max(d.name, d.line_no) FROM d WHERE d.path = s.path AND d.line_no <= s.line_no AND d.name <> '') AS name FROM (SELECT DISTINCT path, line_no FROM site) s""",
)
def fallback_containers(spark, sf_dir):
    """The definition-shaped line before each call, for files without symbols."""
    c, _, sites = _project(spark)
    return ops.fallback_containing(c, sites.select("path", "line_no").distinct(), r"^\s*def\s+(\w+)").select("path", "line_no", "name")


@query("index_fan_out", f"{SQL} SELECT CASE WHEN path LIKE 'core/%' THEN 'first' ELSE 'second' END AS index_name, callee, count(*) AS calls, count(DISTINCT path) AS files FROM site GROUP BY 1, 2")
def index_fan_out(spark, sf_dir):
    """One question to two indexes."""
    sites = _project(spark)[2]
    return ops.fan_out({"first": ops.call_counts(sites.where("path LIKE 'core/%'")), "second": ops.call_counts(sites.where("path NOT LIKE 'core/%'"))})
