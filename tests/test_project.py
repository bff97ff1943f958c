from pyspark.sql import functions as F

from stratalens.functions import text as fn
from stratalens.operators import claims, project
from stratalens.sources import manifests

FILES = "path string, content string"


def test_packages_and_vendored_take_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], FILES)
    assert project.packages(empty).count() == 0 and project.vendored(empty).count() == 0 and manifests.locked(empty).count() == 0
    rows = [(None, "x"), ("a.py", None), ("p\\q\\__init__.py", ""), ("p/q/__init__.pyi", ""), ("p/q/r/z.PY", ""), ("p/q/r/z.PY", "")]
    got = {(r.dir, r.dotted, r.init_file) for r in project.packages(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {("", "", None), ("p/q", "p.q", "p\\q\\__init__.py"), ("p/q/r", "p.q.r", None)}
    one = [("t/go.mod", None), *[(f"t/{k}.go", "// Copyright 2001 A House") for k in range(3)]]
    assert project.vendored(spark.createDataFrame(one, FILES)).count() == 0  # the root holds every file
    got = project.vendored(spark.createDataFrame([*one, ("main.go", None), (None, "x")], FILES)).collect()
    assert [tuple(r) for r in got] == [("t", "A House", 3, 3, 4)]


def test_locks_that_cannot_be_read(spark):
    rows = [("package-lock.json", "{"), ("composer.lock", "[]"), ("Pipfile.lock", None), ("go.sum", "x y z\n"), ("Cargo.lock", "[[package]]\n"), ("poetry.lock", ""), (None, "{}")]
    assert manifests.locked(spark.createDataFrame(rows, FILES)).count() == 0


def test_renames_and_relevance(spark):
    none = spark.createDataFrame([], "name string, display string")
    names = spark.createDataFrame([("a",), (None,), ("a",)], "name string")
    assert sorted((str(r.name), str(r.display)) for r in project.display(names, none).collect()) == [("None", "None"), ("a", "a"), ("a", "a")]
    got = {r.t: r.v for r in spark.createDataFrame([("merge",), ("merged",), ("me",), ("merit",), ("other",), ("",), (None,)], "t string").select("t", fn.relevance(F.col("t"), ["merge"]).alias("v")).collect()}
    assert got == {"merge": 1.0, "merged": 0.8, "me": 0.0, "merit": 0.0, "other": 0.0, "": 0.0, None: 0.0}
    assert spark.range(1).select(fn.relevance(F.lit("merging"), ["merge"]).alias("v")).first().v == 0.6
    assert spark.range(1).select(fn.relevance(F.lit("x"), []).alias("v")).first().v == 0.0
    assert [r.l for r in spark.createDataFrame([("",), (None,), ("no url",)], "u string").select(fn.library(F.col("u")).alias("l")).collect()] == [None, None, None]


def test_scorecard_cost_and_profile_take_nulls_and_empty_tables(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    chart, labels, anchors = "claim int, element int, class string, target string, label string, agreeing int", "claim int, element int, target string, label string", "claim int, target string"
    assert claims.scorecard(made([], chart), made([], labels), made([], anchors)).count() == 0
    got = claims.scorecard(made([(None, 1, "generic", "a", "PRESENT", 1), (1, 1, None, None, None, None)], chart), made([(1, 1, None, None)], labels), made([(1, None)], anchors)).collect()
    assert [(r.claim, r.elements, r.anchors, r.retrieved, r.recall, r.lone_present) for r in got] == [(1, 1, 0, 0, None, 0)]
    usage = "model string, input int, output int, cache_read int, cache_write int"
    assert claims.cost(made([], usage), [], (1.0, 1.0)).count() == 0
    assert [r.usd for r in claims.cost(made([(None, 10**6, None, None, None)], usage), [("x", 9.0, 9.0)], (1.0, 2.0)).collect()] == [1.0]
    paths = made([(None,), ("a/b/c.py",), ("z.zip!a/b/d.py",), ("b/c.js",), ("x",), ("",)], "path string")
    assert sorted(tuple(r) for r in project.profile(paths).collect()) == [("extension", "js", 1), ("extension", "py", 2), ("folder", "a/b", 2)]
