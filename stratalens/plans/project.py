"""Queries over a project's packages, lockfiles, vendored folders, loaded libraries and renames. What the driver's tables
do not hold is stated here, once for the engine and once for SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import text as fn
from stratalens.operators import claims
from stratalens.operators import project as ops
from stratalens.operators.corpus import files
from stratalens.plans.functions import PROJECT, _values
from stratalens.plans.registry import query
from stratalens.plans.search import FILES
from stratalens.sources import manifests

# Lockfiles, and what they hold, read off by hand.
LOCKS = {
    "a/package-lock.json": '{"packages": {"": {"dependencies": {"left": "1"}}, "node_modules/left": {"version": "1.0", "dependencies": {"pad": "1"}}, "node_modules/pad": {"version": "2.0"}}}',
    "b/composer.lock": '{"packages": [{"name": "v/log", "version": "1.1", "require": {"php": ">=8", "v/base": "^1"}}], "packages-dev": [{"name": "v/test", "version": "9", "require": []}]}',
    "c/Pipfile.lock": '{"default": {"flask": {"version": "==3.0"}}, "develop": {"tox": {"version": "==4.1"}, "own": {"path": "."}}}',
    "d/go.sum": "example.org/m v1.2.3 h1:abc=\nexample.org/m v1.2.3/go.mod h1:def=\nexample.org/n v0.1.0/go.mod h1:ghi=\n",
    "e/Cargo.lock": 'version = 3\n\n[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = [\n "serde",\n "syn 1.0 (registry)",\n]\n\n[[package]]\nname = "serde"\nversion = "1.0.9"\nsource = "registry"\n',
    "f/poetry.lock": '[[package]]\nname = "jinja"\nversion = "3.1"\n\n[package.dependencies]\nmarkup = ">=2"\n"babel.x" = {version = "*", optional = true}\n\n[package.extras]\ni18n = ["Babel"]\n\n[[package]]\nname = "markup"\nversion = "2.1"\n\n[metadata]\nlock-version = "2.0"\n',
    "g/Cargo.lock": "no lockfile",
}
LOCKED = """('a/package-lock.json','',NULL,'left'),('a/package-lock.json','left','1.0','pad'),('a/package-lock.json','pad','2.0',NULL),('b/composer.lock','v/log','1.1','v/base'),
 ('b/composer.lock','v/test','9',NULL),('c/Pipfile.lock','flask','3.0',NULL),('c/Pipfile.lock','tox','4.1',NULL),('c/Pipfile.lock','own',NULL,NULL),('d/go.sum','example.org/m','v1.2.3',NULL),
 ('e/Cargo.lock','app','0.1.0','serde'),('e/Cargo.lock','app','0.1.0','syn'),('e/Cargo.lock','serde','1.0.9',NULL),('f/poetry.lock','jinja','3.1','markup'),('f/poetry.lock','jinja','3.1','babel.x'),
 ('f/poetry.lock','markup','2.1',NULL)"""


@query("lockfile_packages", f"SELECT * FROM (VALUES {LOCKED}) AS t(path, package, version, depends_on)")
def lockfile_packages(spark, sf_dir):
    """Packages and their dependencies in six kinds of lockfiles."""
    return manifests.locked(spark.createDataFrame(list(LOCKS.items()), "path string, content string"))


# Addresses, and the libraries behind them, read off by hand.
URLS = """('https://cdn.example.net/npm/@scope/kit@v2.1.0/dist/kit.js','cdn.example.net','@scope/kit','2.1.0'),('https://cdn.example.net/npm/plain','cdn.example.net','plain',NULL),
 ('//cdn.example.net/gh/user/tool@1.2/tool.js','cdn.example.net','tool','1.2'),('https://libs.example.net/ajax/libs/chart/4.4.1/chart.min.js','libs.example.net','chart','4.4.1'),
 ('https://pkg.example.net/view@18/index.js','pkg.example.net','view','18'),('http://H.example.net/js/query-3.7.1.min.js?x=1','h.example.net','query','3.7.1'),
 ('http://h.example.net/d3.v7.min.js','h.example.net','d3','7'),('http://h.example.net/boot.bundle.min.css','h.example.net','boot',NULL),('js/local.js',NULL,NULL,NULL)"""


@query("library_urls", f"SELECT url, host, name, version FROM (VALUES {URLS}) AS t(url, host, name, version)")
def library_urls(spark, sf_dir):
    """Host, name and version of libraries by the address they are loaded from."""
    return spark.sql(f"SELECT url FROM VALUES {URLS} AS t(url, host, name, version)").withColumn("l", fn.library(F.col("url"))).select("url", "l.host", "l.name", "l.version")


@query(
    "project_packages",
    f"""WITH src(path, content) AS (VALUES {_values([*PROJECT.items(), ("core/__init__.py", "")])}), py AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM src WHERE regexp_matches(path, '[.]pyi?$'))
        SELECT dir, replace(dir, '/', '.') AS dotted, max(CASE WHEN path LIKE '%\\_\\_init\\_\\_.py%' ESCAPE '\\' THEN path END) AS init_file FROM py GROUP BY dir""",
)
def project_packages(spark, sf_dir):
    """Packages of the project, declared or implicit."""
    return ops.packages(spark.createDataFrame([*PROJECT.items(), ("core/__init__.py", "")], "path string, content string"))


# A tree with two folders of other projects, one of them under several holders.
TREE = [
    ("app/main.py", "# Copyright 2024 Own House\n"),
    ("app/package.json", "{}"),
    ("app/ext/lib/setup.py", "# Copyright (c) 2019-2021 by Far Maker, Inc. All rights reserved.\n"),
    ("app/ext/lib/a.py", "# Copyright 2019 Far Maker, Inc.\n"),
    ("app/ext/lib/deep/b.py", "# copyright 2020 Other One and/or its affiliates\n"),
    ("app/ext/lib/c.py", "pass\n"),
    ("app/ext/mix/go.mod", "// Copyright 2001 A House\n"),
    ("app/ext/mix/x.go", "// Copyright 2001 B House\n"),
    ("app/ext/mix/y.go", "// Copyright 2001 C House\n"),
    ("app/ext/few/Gemfile", "# Copyright 2001 A House\n"),
]


@query(
    "vendored_subtrees",
    f"""WITH src(path, content) AS (VALUES {_values(TREE)}), h AS (SELECT path, nullif(trim(regexp_replace(regexp_replace(trim(regexp_extract(content, '(?i)copyright\\s*(?:[(]c[)])?\\s*(?:[0-9]{{4}}(?:\\s*[-,]\\s*[0-9]{{4}})?)?\\s*(?:by\\s+)?([^\\n\\r*#/]{{3,60}})', 1)), '(?i)(\\s+all rights reserved.*|[\\s.,]+(and|&|et al)\\.?)$', ''), '[.,;:]+$', '')), '') AS holder FROM src),
        r AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS root FROM src WHERE regexp_matches(path, '/(setup[.]py|pyproject[.]toml|package[.]json|Cargo[.]toml|go[.]mod|composer[.]json|Gemfile)$')),
        n AS (SELECT root, holder, count(*) AS n FROM r JOIN h ON starts_with(path, root || '/') GROUP BY 1, 2),
        g AS (SELECT root, sum(n)::BIGINT AS files, coalesce(sum(n) FILTER (holder IS NOT NULL), 0)::BIGINT AS headered FROM n GROUP BY root),
        t AS (SELECT root, holder, n FROM n WHERE holder IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, holder) = 1)
        SELECT root, holder, n AS holder_files, headered, files FROM g JOIN t USING (root) WHERE files < (SELECT count(*) FROM src) AND headered >= 3 AND n >= 0.5 * headered""",
)
def vendored_subtrees(spark, sf_dir):
    """Folders that hold another project, by their notices."""
    return ops.vendored(spark.createDataFrame(TREE, "path string, content string"))


KEYWORDS = ["ation", "the", "thanked", "encode"]


@query(
    "token_relevance",
    f"""WITH {FILES}, t AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(content), '[a-z]{{{{3,}}}}')) AS token FROM files), n AS (SELECT token, count(*) AS files FROM t GROUP BY 1), k(w) AS (VALUES {", ".join(f"('{w}')" for w in KEYWORDS)}),
        s AS (SELECT token, files, max(CASE WHEN token = w THEN 1.0 WHEN length(w) >= 3 AND (contains(token, w) OR contains(w, token)) THEN 0.8 WHEN length(token) >= 4 AND length(w) >= 4 AND substr(token, 1, 4) = substr(w, 1, 4) THEN 0.6 ELSE 0 END)::DOUBLE AS relevance FROM n, k GROUP BY 1, 2)
        SELECT token, files, relevance FROM s WHERE relevance > 0""".replace("{{", "{").replace("}}", "}"),
)
def token_relevance(spark, sf_dir):
    """The corpus's words that are near the words of a claim, counted in the row before the shuffle."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0)))
    n = files(spark, sf_dir).select("path", F.explode(own).alias("token")).distinct().groupBy("token").agg(F.count("*").alias("files"))
    return n.withColumn("relevance", fn.relevance(F.col("token"), KEYWORDS)).where("relevance > 0")


# Names of a project, and the renames that were inferred for some.
NAMES = ["a1", "a1::run", "b2", "b2::go", "b2::go::on", "plain", "plain::x"]
RENAMES = {"a1": "a1_KW_LOAD", "b2::go": "b2_KW_MOVE::go", "b2::go::on": "b2_KW_MOVE::go_on", "the": "the_KW_ARTICLE", "and": "and_KW_JOIN", "to": "to_CMD_SEND"}


@query(
    "display_names",
    f"""WITH n(name) AS (VALUES {_values([(n,) for n in NAMES])}), r(name, display) AS (VALUES {_values(RENAMES.items())})
        SELECT n.name, coalesce(a.display, b.display || '::' || regexp_extract(n.name, '^(.*)::(.*)$', 2), n.name) AS display FROM n LEFT JOIN r a ON a.name = n.name LEFT JOIN r b ON b.name = regexp_extract(n.name, '^(.*)::(.*)$', 1)""",
)
def display_names(spark, sf_dir):
    """Names as they are shown: renamed whole, or by their class."""
    return ops.display(spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame(list(RENAMES.items()), "name string, display string"))


@query(
    "rename_expansion",
    f"""WITH {FILES}, r(token, display) AS (VALUES {_values(RENAMES.items())}), t AS (SELECT path, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM files)
        SELECT path, token, count(*) AS uses FROM t JOIN r USING (token) WHERE regexp_matches(display, '_KW_') GROUP BY 1, 2""",
)
def rename_expansion(spark, sf_dir):
    """Uses of the originals of every display name that a query matches."""
    return ops.renamed_hits(files(spark, sf_dir), spark.createDataFrame(list(RENAMES.items()), "name string, display string"), "_KW_")


@query(
    "corpus_profile",
    f"""WITH {FILES}, p AS (SELECT path || '.' || ext AS path FROM files), e AS (SELECT regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) AS value, count(*) AS n FROM p GROUP BY 1),
        d AS (SELECT string_split(path, '/')[-3] || '/' || string_split(path, '/')[-2] AS value, count(*) AS n FROM p WHERE len(string_split(path, '/')) > 2 GROUP BY 1)
        SELECT * FROM (SELECT 'extension' AS kind, value, n FROM e WHERE value <> '' ORDER BY n DESC, value LIMIT 6) UNION ALL SELECT * FROM (SELECT 'folder' AS kind, value, n FROM d ORDER BY n DESC, value LIMIT 10)""",
)
def corpus_profile(spark, sf_dir):
    """The extensions and folders that most documents are in."""
    return ops.profile(files(spark, sf_dir).select(F.concat("path", F.lit("."), "ext").alias("path")))


# Two charts, what each target was given, and the targets expected.
CHART = "(1,1,'mechanism','a','PRESENT',2),(1,2,'mechanism','x','PRESENT',1),(1,3,'generic','b','PRESENT',1),(1,4,'mechanism',NULL,'ABSENT',NULL),(1,NULL,'preamble','a','PRESENT',3),(2,1,'generic','z','PARTIAL',0)"
LABELS = "(1,1,'a','PRESENT'),(1,2,'x','PRESENT'),(1,2,'b','PARTIAL'),(1,4,'b','PRESENT'),(1,NULL,'c','NONE'),(2,1,'z','PARTIAL')"
ANCHORS = "(1,'a'),(1,'b'),(1,'d'),(1,'a'),(3,'q')"


@query(
    "chart_scorecard",
    f"""WITH c(claim, element, class, target, label, agreeing) AS (VALUES {CHART}), l(claim, element, target, label) AS (VALUES {LABELS}), a(claim, target) AS (SELECT DISTINCT * FROM (VALUES {ANCHORS})),
        r AS (SELECT c.*, EXISTS (FROM a WHERE a.claim = c.claim AND a.target = c.target) AS hit, EXISTS (FROM l JOIN a USING (claim, target) WHERE l.claim = c.claim AND l.element = c.element AND l.label = 'PRESENT') AS backed FROM c WHERE element IS NOT NULL),
        k AS (SELECT claim FROM r UNION SELECT claim FROM a), n AS (SELECT claim, (SELECT count(*) FROM a WHERE a.claim = k.claim) AS anchors, (SELECT count(DISTINCT l.target) FROM l JOIN a USING (claim, target) WHERE l.claim = k.claim) AS retrieved FROM k)
        SELECT n.claim, anchors, retrieved, CASE WHEN anchors > 0 THEN round(retrieved / anchors, 2) END AS recall, count(element) AS elements, count(*) FILTER (class = 'mechanism') AS mechanism_rows,
               count(*) FILTER (class = 'mechanism' AND label = 'PRESENT') AS mechanism_present, count(*) FILTER (class = 'mechanism' AND label = 'PRESENT' AND hit) AS present_on_anchor,
               count(*) FILTER (class = 'mechanism' AND label = 'PRESENT' AND NOT hit) AS present_elsewhere, count(*) FILTER (class = 'mechanism' AND backed) AS anchor_supported,
               count(*) FILTER (class = 'generic') AS generic_rows, count(*) FILTER (class = 'generic' AND label = 'PRESENT') AS generic_present, count(*) FILTER (label = 'PRESENT' AND agreeing <= 1) AS lone_present
        FROM n LEFT JOIN r USING (claim) GROUP BY ALL""",
)
def chart_scorecard(spark, sf_dir):
    """How much of what was expected each chart found and cited."""
    given = lambda v, names: spark.sql(f"SELECT * FROM VALUES {v} AS t({names})")
    return claims.scorecard(given(CHART, "claim, element, class, target, label, agreeing"), given(LABELS, "claim, element, target, label"), given(ANCHORS, "claim, target"))


RATES = [("small-[0-9]-lite", 0.1, 0.4), ("small-[0-9]", 0.3, 2.5), ("^big", 5.0, 25.0)]
USAGE = "('Small-2-lite',1000,200,NULL,0),('small-2',1000,200,500,100),('big-1',5,NULL,0,0),('my-big-1',1000000,0,0,0),(NULL,10,10,10,10)"


@query(
    "usage_cost",
    f"""WITH u(model, input, output, cache_read, cache_write) AS (VALUES {USAGE}), z AS (SELECT *, coalesce(input, 0) AS i, coalesce(output, 0) AS o, coalesce(cache_read, 0) AS r, coalesce(cache_write, 0) AS w FROM u),
        p AS (SELECT *, CASE WHEN regexp_matches(model, '(?i)small-[0-9]-lite') THEN 1 WHEN regexp_matches(model, '(?i)small-[0-9]') THEN 2 WHEN regexp_matches(model, '(?i)^big') THEN 3 ELSE 4 END AS k FROM z),
        q AS (SELECT *, [0.1, 0.3, 5.0, 2.0][k]::DOUBLE AS a, [0.4, 2.5, 25.0, 8.0][k]::DOUBLE AS b FROM p)
        SELECT model, input, output, cache_read, cache_write, i + r + w AS in_tokens, o AS out_tokens, (i * a + r * a * 0.1 + w * a * 1.25 + o * b) / 1e6 AS usd FROM q""",
)
def usage_cost(spark, sf_dir):
    """What usage of models costs at stated rates."""
    return claims.cost(spark.sql(f"SELECT * FROM VALUES {USAGE} AS t(model, input, output, cache_read, cache_write)"), RATES, (2.0, 8.0))
