from pyspark.sql import functions as F

from stratalens.operators import claims
from stratalens.operators.corpus import files
from stratalens.operators.multisect import Term, multisect, parse_terms
from stratalens.sources import manifests, sinks

TEXT = """1. A device comprising: (a) a wheel; and (b) an axle
  held in place.
2. The device of claim 1, with a brake.
3. The device of any of claims 1 to 2; in red.
4) A thing as in claim 4.
"""


def test_claims(spark):
    found = claims.claims(spark.createDataFrame([("x", TEXT), ("y", None), ("z", "")], "doc string, text string")).cache()
    got = {r.n: (r.dependent, r.parents) for r in found.collect()}
    assert got == {1: (False, []), 2: (True, [1]), 3: (True, [1, 2]), 4: (True, [4])}
    assert {r.n: (r.depth, r.chain) for r in claims.chains(found).collect()} == {1: (0, [1]), 2: (1, [2, 1]), 3: (1, [3, 1]), 4: (0, [4])}
    assert [r.text for r in claims.elements(found.where("n = 1")).orderBy("element").collect()] == ["A device comprising:", "(a) a wheel", "(b) an axle", "held in place."]


def test_manifests(spark):
    files_ = [
        ("a/package.json", '{"dependencies": {"left": "1", "lost": "2"}, "devDependencies": {"lint": "3"}}'),
        ("a/package-lock.json", '{"packages": {"": {"dependencies": {"left": "1"}}, "node_modules/left": {"version": "1.0", "dependencies": {"pad": "1"}}, "node_modules/pad": {"version": "2.0", "dependencies": {"left": "1"}}}}'),
        ("b/requirements.txt", "# no\nnumpy==1.2\nflask\n"),
        ("c/go.mod", "module x\nrequire example.org/m v1.2.3\n"),
        ("d/other.txt", None),
    ]
    c = spark.createDataFrame(files_, "path string, content string")
    d = manifests.declared(c)
    assert {(r.name, r.version, r.dev) for r in d.collect()} == {("left", "1", False), ("lost", "2", False), ("lint", "3", True), ("numpy", "1.2", False), ("flask", None, False), ("example.org/m", "v1.2.3", False)}
    k = manifests.locked(c)
    assert {tuple(r.chain) for r in manifests.chains(k).collect()} == {("left",), ("left", "pad")}
    used = spark.createDataFrame([("left",), ("pad",), ("zap",)], "name string")
    got = {(r.name, r.state) for r in manifests.bom(d.where("path = 'a/package.json'"), used, k).collect()}
    assert got == {("lost", "not imported"), ("lost", "not locked"), ("lint", "dev not imported"), ("pad", "transitive"), ("zap", "absent")}


def test_sinks(spark, tmp_path):
    corpus = files(spark, "/root/testdata/sf0.001")
    sinks.write_index(corpus, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "files")).count() == corpus.count()
    e = spark.createDataFrame([("a b", "c", 2), ("c", "a b", 5)], "src string, dst string, calls int")
    assert [r.line for r in sinks.mermaid(e).collect()] == ["  c -->|5| a_b", "  a_b -->|2| c"]
    old, new = (spark.createDataFrame(rows, "key string, n int, source string") for rows in ([("x", 1, "s1"), ("y", 9, "s1")], [("x", 3, "s2")]))
    assert {(r.key, r.n, tuple(r.provenance)) for r in sinks.merge_catalog(old, new, "key", "n").collect()} == {("x", 3, ("s1", "s2")), ("y", 9, ("s1",))}
    assert {(r.key, r.n) for r in sinks.merge_vectors(old, new).collect()} == {("x", 3), ("y", 9)}


def test_multisect_gates(spark):
    rows = [("f", "f/1", "py", "alpha beta\n# gamma", 1), ("f", "f/2", "py", "alpha\nbeta gamma", 2), ("g", "g/1", "py", "alpha beta delta", 3)]
    corpus = spark.createDataFrame(rows, "folder string, path string, ext string, content string, doc_id long")
    got = multisect(corpus, [Term("alpha"), Term("beta"), Term("gamma", soft=True), Term("absent"), Term("delta", negated=True)], "path").collect()
    assert [(r.path, r.weighted_terms) for r in got] == [("f/2", 3.0), ("f/1", 2.25)]
    assert parse_terms("a.b; NOT c; d?; /e+/")[0].pattern
    assert multisect(corpus, [Term("alpha")], "folder").agg(F.count("*")).first()[0] == 2
