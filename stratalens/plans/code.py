"""Queries over source code. The driver's tables hold none, so the corpus is a fixture built in the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.operators.code import bodies, call_sites, callers, imports, symbols
from stratalens.plans.registry import query

FIXTURE = {
    "app/main.py": 'import os\nfrom util.text import clean, join\n\nclass Runner:\n    def run(self, items):\n        def inner(x):\n            return clean(x)\n        return join([inner(i) for i in items])\n\ndef main():\n    r = Runner()\n    r.run(os.listdir("."))\n',
    "util/text.py": 'import re\n\ndef clean(s):\n    # clean(s) in a comment is no call\n    return re.sub("x", "", s)\n\ndef join(parts):\n    return ",".join(clean(p) for p in parts)\n',
    "util/copy.py": 'import re\n\ndef clean(s):\n    # clean(s) in a comment is no call\n    return re.sub("x", "", s)\n\ndef glue(bits):\n    return ";".join(clean(b) for b in bits)\n',
    "web/app.js": 'import { get } from "./http.js";\nconst fs = require("fs");\n\nexport function start(port) {\n  const s = "function fake() {";\n  return get(port);\n}\n\nclass Server {\n}\n\nconst stop = (x) => {\n  start(x);\n};\n',
    "lib/add.c": '#include <stdio.h>\n#include "add.h"\n\nint add(int a, int b) {\n  /* add(1, 2) */\n  return a + b;\n}\n\nint twice(int a) {\n  return add(a, a);\n}\n',
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n)\n\nfunc main() {\n\tfmt.Println(help(1))\n}\n\nfunc help(n int) int {\n\treturn n\n}\n',
    "jv/Box.java": "import java.util.List;\n\npublic class Box {\n  public int size(List<String> xs) {\n    return xs.size();\n  }\n}\n",
    "rb/tool.rb": "def greet(name)\n  puts(name)\nend\n",
    "rs/lib.rs": "use std::io::Read;\n\npub fn load(n: u32) -> u32 {\n    n + 1\n}\n",
}


# What the fixture holds, read off by hand.
ROWS = {
    "symbols": """('app/main.py','Runner','Runner',4,8,'class'),('app/main.py','Runner.run','run',5,8,'method'),('app/main.py','Runner.run.inner','inner',6,7,'function'),
 ('app/main.py','main','main',10,12,'function'),('jv/Box.java','Box','Box',3,7,'class'),('jv/Box.java','size','size',4,6,'function'),('lib/add.c','add','add',4,7,'function'),
 ('lib/add.c','twice','twice',9,11,'function'),('rb/tool.rb','greet','greet',1,3,'function'),('rs/lib.rs','load','load',3,5,'function'),('srv/main.go','help','help',11,13,'function'),
 ('srv/main.go','main','main',7,9,'function'),('util/copy.py','clean','clean',3,5,'function'),('util/copy.py','glue','glue',7,8,'function'),('util/text.py','clean','clean',3,5,'function'),
 ('util/text.py','join','join',7,8,'function'),('web/app.js','Server','Server',9,10,'class'),('web/app.js','start','start',4,7,'function'),('web/app.js','stop','stop',12,14,'function')""",
    "sites": """('app/main.py',7,'clean','simple','Runner.run.inner'),('app/main.py',8,'inner','simple','Runner.run'),('app/main.py',8,'join','simple','Runner.run'),
 ('app/main.py',11,'Runner','simple','main'),('app/main.py',12,'run','member','main'),('app/main.py',12,'listdir','member','main'),('util/text.py',5,'sub','member','clean'),
 ('util/text.py',8,'join','member','join'),('util/text.py',8,'clean','simple','join'),('util/copy.py',5,'sub','member','clean'),('util/copy.py',8,'join','member','glue'),
 ('util/copy.py',8,'clean','simple','glue'),('web/app.js',6,'get','simple','start'),('web/app.js',13,'start','simple','stop'),('lib/add.c',10,'add','simple','twice'),
 ('srv/main.go',8,'Println','member','main'),('srv/main.go',8,'help','simple','main'),('jv/Box.java',5,'size','member','size'),('rb/tool.rb',2,'puts','simple','greet')""",
    "imports": """('app/main.py',1,'py','os',NULL),('app/main.py',2,'py','util.text','util/text.py'),('jv/Box.java',1,'java','java.util.List',NULL),('lib/add.c',1,'c','stdio.h',NULL),
 ('lib/add.c',2,'c','add.h','lib/add.c'),('rs/lib.rs',1,'rs','std::io::Read',NULL),('srv/main.go',4,'go','fmt',NULL),('util/copy.py',1,'py','re',NULL),('util/text.py',1,'py','re',NULL),
 ('web/app.js',1,'js','./http.js',NULL),('web/app.js',2,'js','fs',NULL)""",
}
SQL = f"""WITH sym(path, name, base_name, s, e, type) AS (VALUES {ROWS["symbols"]}), site(path, line_no, callee, call_type, caller) AS (VALUES {ROWS["sites"]}),
 imp(path, line_no, lang, module, target) AS (VALUES {ROWS["imports"]})"""


def corpus(spark):
    return spark.createDataFrame(list(FIXTURE.items()), "path string, content string")


@query("symbols", f"{SQL} SELECT path, name, base_name, s::INT AS start, e::INT AS \"end\", type FROM sym")
def symbols_query(spark, sf_dir):
    """Definitions with their ranges."""
    return symbols(corpus(spark))


@query("imports", f"{SQL} SELECT path, line_no::INT AS line_no, lang, module FROM imp")
def imports_query(spark, sf_dir):
    """Import statements by language."""
    return imports(corpus(spark))


@query("call_inventory", f"{SQL} SELECT callee, count(*) AS sites, count(DISTINCT path) AS files, callee IN (SELECT base_name FROM sym) AS inside FROM site GROUP BY callee")
def call_inventory(spark, sf_dir):
    """Call targets, inside the corpus or outside, with their sites."""
    c = corpus(spark)
    known = symbols(c).select(F.col("base_name").alias("callee")).distinct().withColumn("inside", F.lit(True))
    g = call_sites(c, symbols(c)).groupBy("callee").agg(F.count("*").alias("sites"), F.count_distinct("path").alias("files"))
    return g.join(known, "callee", "left").select("callee", "sites", "files", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("callers", f"{SQL} SELECT callee, path, line_no::INT AS line_no, call_type, caller FROM site WHERE callee IN (SELECT base_name FROM sym)")
def callers_query(spark, sf_dir):
    """Calls of known names and the innermost function around each."""
    c = corpus(spark)
    return callers(c, symbols(c))


@query("function_dupes", "SELECT * FROM (VALUES (2::BIGINT, 1::BIGINT, 'util/copy.py:clean,util/text.py:clean'), (2, 2, 'util/copy.py:glue,util/text.py:join')) AS t(n, bodies, members)")
def function_dupes(spark, sf_dir):
    """Functions by body and by structure."""
    c = corpus(spark)
    b = bodies(c, symbols(c).where("type <> 'class'"))
    g = b.groupBy("struct_hash").agg(F.count("*").alias("n"), F.count_distinct("body_hash").alias("bodies"), F.array_sort(F.collect_list(F.concat_ws(":", "path", "name"))).alias("members"))
    return g.where("n > 1").select("n", "bodies", F.array_join("members", ",").alias("members"))


@query("import_resolution", f"{SQL} SELECT path, line_no::INT AS line_no, module, target, CASE WHEN target IS NULL THEN 'external' ELSE 'internal' END AS state FROM imp")
def import_resolution(spark, sf_dir):
    """Imports met by a module of the corpus, by path suffix."""
    c = corpus(spark)
    want = imports(c).withColumn("key", F.regexp_replace(F.regexp_replace("module", r"^\./", ""), r"\.(js|h)$", ""))
    want = want.withColumn("key", F.when(F.col("lang") == "py", F.regexp_replace("key", r"\.", "/")).otherwise(F.col("key")))
    stem = F.regexp_replace("path", r"\.\w+$", "")
    parts = F.split(stem, "/")
    have = c.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("key"))
    j = want.join(have, "key", "left").groupBy("path", "line_no", "module").agg(F.min("target").alias("target"))
    return j.withColumn("state", F.when(F.col("target").isNull(), "external").otherwise("internal"))
