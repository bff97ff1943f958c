"""Queries on odd and larger tables of the tests' own, against their SQL."""

import datetime
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_queries import rows

from stratalens.operators import corpus
from stratalens.plans import analytics, extras, registry, relations  # noqa: F401


def against_sql(spark, folder, name, **tables):
    """The query's and its SQL's rows over tables of pandas."""
    c = duckdb.connect()
    for t, df in tables.items():
        c.register(f"_{t}", df)
        c.execute(f"COPY (SELECT * FROM _{t}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), c.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)


def some_events():
    """Clicks and purchases within a second of each other, half a second apart, repeated, and of nobody."""
    at = datetime.datetime(2024, 1, 1)
    seconds = [(1, 1, "click", 10.6), (2, 1, "purchase", 10.7), (3, 1, "purchase", 10.4), (4, 1, "click", 20.5), (5, 1, "purchase", 20.2), (6, 1, "purchase", 19.9)]
    seconds += [(7, 2, "purchase", 50.0), (7, 2, "purchase", 50.0), (7, 1, "purchase", 50.0), (8, None, "click", 1.0), (9, None, "purchase", 2.0), (40, 2, "click", 49.6), (10, 2, "purchase", 49.5)]
    return pd.DataFrame([(i, at + datetime.timedelta(seconds=s), u, k) for i, u, k, s in seconds], columns=["event_id", "ts", "user_id", "event_type"]).astype({"user_id": "Int64", "ts": "datetime64[us]"})


@pytest.mark.parametrize("name", ["asof_containing", "innermost_containing", "latest_containing"])
def test_ranges_by_whole_seconds(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, events=some_events())
    assert got == want


def test_rank_correlation_of_one_value(spark, tmp_path):
    # 60,001 rows: the square of their ranks' sum is beyond what a double holds exactly
    n = 60_001
    part = pd.DataFrame({"p_partkey": range(n), "p_brand": "B", "p_size": [i % 7 for i in range(n)], "p_retailprice": 950.0})
    odd = pd.DataFrame({"p_partkey": range(6), "p_brand": [None] * 6, "p_size": [1, 2, None, 4, 4, 6], "p_retailprice": [100.0, None, 300.0, 200.0, 500.0, 600.0]})
    got, want = against_sql(spark, tmp_path, "spearman", part=pd.concat([part, odd]).astype({"p_size": "Int32"}))
    assert got == want


@pytest.mark.parametrize("block", [3, 2048])
def test_surprise_counts_kinds(spark, tmp_path, monkeypatch, block):
    """Members alike in all, repeated ids, nulls; each kind is met once however many members it has."""
    monkeypatch.setattr(analytics, "MEMBER_BLOCK", block)
    names = ["Red ring", "ring red", "big bolt", None, "red bolt red"]
    part = pd.DataFrame([(i % 170, names[i % 5], None if i % 9 == 0 else f"b{i % 2}", f"t{i % 2}", None if i % 8 == 0 else i % 3, 900.0) for i in range(200)], columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).astype({"p_size": "Int32"})
    got, want = against_sql(spark, tmp_path, "surprise_pairs", part=part)
    assert got == want
    cell = {"grp": ["g"], "id": pa.array([None], pa.int64()), "dir": ["a"], "size": [1], "toks": [["x"]], "n": [3_000_000], "own": [0], "i": [0], "j": [0]}
    assert analytics._surprise(pa.table(cell)).column("pairs").to_pylist() == [3_000_000 * 2_999_999 // 2]


def some_documents():
    """Rows that share a path, by null or repeated ids and by null sources; digits before and within words; a text beyond a stretch."""
    words = "alpha betaGamma HTTPServer 12abc x_1 the NOT ALLCAPS _ __ a1b2 9 naïve delta_delta".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 4 + i % 9)) + f" only{i} pair{i // 2} near{i // 15} far{i // 30}", "en" if i % 2 else "de", f"src{i % 4}") for i in range(90)]
    rows += [(None, "alpha alpha shared_words one_path", "en", "src1"), (None, "shared_words one_path", "en", "src1"), (7, "shared_words alpha", "en", "src3"), (7, "twice twice", None, "src3"), (8, "twice", "src3", None)]
    rows += [(8, "onlyNull", None, None), (100, None, "en", "src0"), (101, "", "en", "src0"), (102, "1 2 3 é", "en", "src0"), (103, "alpha9 " * 200_000 + "last", "en", "src2"), (104, "y" * (1 << 21) + " alpha9", "en", "src2")]
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})


@pytest.mark.parametrize("held", [50, 1 << 20])
@pytest.mark.parametrize("name", ["vocabulary", "vocabulary_places", "vocabulary_density", "idf_formulas", "rare_tokens"])
def test_tokens_by_blocks_of_files(spark, tmp_path, monkeypatch, name, held):
    monkeypatch.setattr(corpus, "HELD", held)
    monkeypatch.setattr(corpus, "OUT_ROWS", min(held, 1 << 16))
    got, want = against_sql(spark, tmp_path, name, documents=some_documents())
    assert got == want


@pytest.mark.parametrize("name", ["vocabulary", "vocabulary_places", "rare_tokens"])
def test_tokens_where_many_paths_are_shared(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(corpus, "SHARED_PATHS", 1)
    got, want = against_sql(spark, tmp_path, name, documents=some_documents())
    assert got == want


def test_places_of_frequent_tokens_stay(spark):
    """A token of many files takes three rows of a block, or none, not one a file."""
    f = spark.createDataFrame([(f"p{i:03}", "a", "hot hot" if i == 50 else f"hot own{i}") for i in range(100)], "path string, folder string, content string").coalesce(1)
    (best,) = corpus.token_places(f, best=3).where("token = 'hot'").collect()
    assert (best.files, [tuple(x) for x in best.places]) == (100, [(-2, "p050"), (-1, "p000"), (-1, "p001")])
    few = {r.token: (r.files, len(r.places)) for r in corpus.token_places(f, few=20).collect()}
    assert few["hot"] == (100, 0) and few["own7"] == (1, 1) and len(few) == 100


@pytest.mark.parametrize("block", [3, 256])
def test_fingerprints_of_odd_sets(spark, tmp_path, monkeypatch, block):
    """Nulls, sets of nothing but null, repeated rows, large sets, copies, and a token in all; most pairs are told by bits."""
    monkeypatch.setattr(analytics, "TOKEN_BLOCK", block)
    rng = random.Random(8)
    rows = [(a, rng.randrange(40)) for a in range(120) for _ in range(1 + a % 9)] + [(a, 7) for a in range(30)] + [(5, 3)] * 4
    rows += [(200 + k, t) for k in range(6) for t in range(1000 + 7 * k, 1150 + 7 * k)] + [(300 + k, t) for k in range(5) for t in (1, 2, 3)]
    rows += [(None, 7), (None, None), (400, None), (401, None), (402, None), (402, 7), (3, None), (3, None)]
    lineitem = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey"]).astype("Int64")
    got, want = against_sql(spark, tmp_path, "token_fingerprint_pairs", lineitem=lineitem)
    assert got == want
    plan = registry.QUERIES["token_fingerprint_pairs"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "bit_count" in plan


def test_margin_holds_no_list_of_all_cosines():
    """Ten million cosines of one query, a batch at a time, in less memory than they take."""
    rng = np.random.default_rng(8)
    parts = [np.round(rng.normal(0, 0.1, 50_000), 4).astype(np.float32) for _ in range(200)]
    whole = np.round(np.concatenate(parts).astype(np.float64), 6)
    lists = lambda p: pa.ListArray.from_arrays(pa.array([0, 10, len(p)], pa.int32()), pa.array(np.round(p.astype(np.float64), 6)))
    batches = (pa.RecordBatch.from_arrays([pa.array([100, 100]), lists(p)], names=["q_id", "cos"]) for p in parts)
    tracemalloc.start()
    ((q, mid, margin),) = [tuple(c[0].as_py() for c in b.columns) for b in relations._margin((pa.scalar(100),), batches)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (q, mid, margin) == (100, np.median(whole), whole.max() - np.median(whole))
    assert peak < whole.nbytes / 2
    none = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[]], pa.list_(pa.float64()))], names=["q_id", "cos"])
    assert [b.to_pylist() for b in relations._margin((pa.scalar(1),), iter([none]))] == [[{"q_id": 1, "median": None, "margin": None}]]
    odd = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[0.5, float("nan"), 0.25]])], names=["q_id", "cos"])
    (b,) = relations._margin((pa.scalar(1),), iter([odd]))
    assert b.column("median")[0].as_py() == 0.5 and np.isnan(b.column("margin")[0].as_py())


def test_cells_of_odd_vectors():
    """Null vectors, null components, empty and zero ones, and two dimensions, in several chunks."""
    vectors = [[1.0, 0.0], None, [0.6, 0.8], [None, 1.0], [], [0.0, 0.0], [1.0, 2.0, 2.0], [0.0, 3.0, 4.0], [-1.0, 0.0]]
    e = pa.array(vectors * 2, pa.list_(pa.float64()))
    n = len(vectors)
    cell = pa.table({"vec_id": range(2 * n), "is_query": [True] * n + [False] * n, "label": [1] * (2 * n), "e": pa.chunked_array([e.slice(0, 4), e.slice(4)])})
    cos, null = relations._cosine_cell(lambda q, ql, v, vl, cos, null, apart: (cos, null))(cell)
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            lost = x is None or y is None or None in x or None in y or len(x) != len(y)
            assert null[i, j] == lost
            if not lost:
                with np.errstate(all="ignore"):
                    want = np.round(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)), 6)
                assert cos[i, j] == want or (np.isnan(cos[i, j]) and np.isnan(want))
