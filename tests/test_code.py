from stratalens.operators import code
from stratalens.plans.code import FIXTURE, corpus
from stratalens.plans.registry import QUERIES


def test_symbol_ranges(spark):
    got = {(r.path, r.name, r.start, r.end, r.type) for r in code.symbols(corpus(spark)).collect()}
    assert ("app/main.py", "Runner.run", 5, 8, "method") in got
    assert ("app/main.py", "Runner.run.inner", 6, 7, "function") in got
    assert ("web/app.js", "start", 4, 7, "function") in got
    assert ("web/app.js", "stop", 12, 14, "function") in got
    assert ("lib/add.c", "twice", 9, 11, "function") in got
    assert ("srv/main.go", "help", 11, 13, "function") in got
    assert ("jv/Box.java", "size", 4, 6, "function") in got
    assert ("rb/tool.rb", "greet", 1, 3, "function") in got
    assert not any(n == "fake" for _, n, *_ in got)


def test_repeated_names_are_numbered(spark):
    df = spark.createDataFrame([("a.py", "def f():\n    pass\n\ndef f():\n    pass\n"), ("b.bin", ""), ("c.py", None), ("d.py", "def broken(:\n  x\n")], "path string, content string")
    got = sorted((r.path, r.name) for r in code.symbols(df).collect())
    assert got == [("a.py", "f"), ("a.py", "f@2"), ("d.py", "broken")]


def test_callers_find_the_innermost_function(spark):
    got = {(r.callee, r.path, r.line_no): r.caller for r in QUERIES["callers"](spark, "").collect()}
    assert got["clean", "app/main.py", 7] == "Runner.run.inner"
    assert got["start", "web/app.js", 13] == "stop"
    assert got["add", "lib/add.c", 10] == "twice"
    assert ("clean", "util/text.py", 4) not in got


def test_structural_groups_survive_renames(spark):
    got = {r.members: (r.n, r.bodies) for r in QUERIES["function_dupes"](spark, "").collect()}
    assert got["util/copy.py:clean,util/text.py:clean"] == (2, 1)
    assert got["util/copy.py:glue,util/text.py:join"] == (2, 2)


def test_imports(spark):
    got = {(r.path, r.module) for r in QUERIES["imports"](spark, "").collect()}
    assert {("app/main.py", "os"), ("app/main.py", "util.text"), ("web/app.js", "./http.js"), ("web/app.js", "fs"), ("lib/add.c", "stdio.h"), ("lib/add.c", "add.h"), ("srv/main.go", "fmt"), ("jv/Box.java", "java.util.List"), ("rs/lib.rs", "std::io::Read")} <= got
    resolved = {(r.path, r.module): r.target for r in QUERIES["import_resolution"](spark, "").collect()}
    assert resolved["app/main.py", "util.text"] == "util/text.py"
    assert resolved["app/main.py", "os"] is None
    assert len(FIXTURE) == 9


def test_scalars_of_code(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    lit = F.lit
    assert value(code.is_noise(lit("a/vendor/x.c"), lit("int a;"))) and not value(code.is_noise(lit("a/x.c"), lit("int a;")))
    assert value(code.is_noise(lit("x.js"), lit("a" * 1000))) and value(code.is_noise(lit("x.go"), lit("// DO NOT EDIT")))
    assert value(code.is_opaque(lit("a1"))) and not value(code.is_opaque(lit("parse")))
    assert value(code.code_lines(lit("a;\n\n// no\n/* x\n y */\nb; // c\n"))) == 2
    assert value(code.tight_structure(lit("a;"))) is None
    body = "if (a) { x(); } else { for (;;) { y(1); y(2); y(3); y(4); } }"
    assert value(code.tight_structure(lit(body))) == "if (_) { _() ; } else { for ( ;  ; ) { _(0) ; _(0)*3 ; } }"
    subs = value(code.substitutions(lit("return add(a, 1);"), lit("return sub(b, 1);")))
    assert [(s.a, s.b) for s in subs] == [("add", "sub"), ("a", "b")]
    assert value(code.substitutions(lit("return add(a);"), lit("return add(a, b);"))) is None


def test_comments_and_loads(spark):
    df = spark.createDataFrame([("a.c", "/* block\n one */ int a; // line\n"), ("b.py", "# hash\nimportlib.import_module('os')\n__import__(name)\n"), ("c", None)], "path string, content string")
    assert {(r.kind, r.text) for r in code.comments(df).collect()} == {("block", "block one"), ("line", "line"), ("hash", "hash")}
    assert {(r.target, r.literal) for r in code.dynamic_loads(df).collect()} == {("'os'", True), ("name", False)}
