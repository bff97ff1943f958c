"""Queries that work in blocks, with blocks small enough to meet each other, against DuckDB."""

import os

import duckdb
import pytest
from test_queries import SF, rows

from stratalens.plans import analytics, registry, relations

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
@pytest.mark.parametrize("name", ["cosine_topk", "semantic_tiers", "listing_margin", "fused_rank", "across_elements", "recall_at_k"])
def test_every_hundredth_vector_is_a_query(spark, monkeypatch, name):
    monkeypatch.setattr(relations, "QUERY_BLOCK", 2)
    monkeypatch.setattr(relations, "VECTOR_BLOCK", 128)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duck.sql(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_tables
@pytest.mark.parametrize("block", [8, 256])
def test_pairs_of_all_tokens(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "TOKEN_BLOCK", block)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = duck.sql(registry.ORACLES["token_fingerprint_pairs"]).df()
    got = registry.QUERIES["token_fingerprint_pairs"](spark, SF).toPandas()
    assert rows(got) == rows(want)


@needs_tables
@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_of_whole_groups(spark, monkeypatch, block):
    monkeypatch.setattr(analytics, "MEMBER_BLOCK", block)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = duck.sql(registry.ORACLES["surprise_pairs"]).df()
    got = registry.QUERIES["surprise_pairs"](spark, SF).toPandas()
    assert rows(got) == rows(want)
