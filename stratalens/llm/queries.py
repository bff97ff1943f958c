"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from stratalens.session import table

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .language_id import identify_language
from .line_dedup import line_dedup
from .minhash import minhash_dedup
from .mixing import mix_sources
from .packing import best_fit_pack
from .secrets import scan_secrets
from .substring_dedup import substring_dedup

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def mix_levels():
    """The tree of the mixing query: domains (sources dealt by checksum), then languages, then sources."""
    domain = F.concat(F.lit("d"), F.crc32(F.col("source").cast("binary")) % 3)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@query
def op2_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


#: Weights of domains and of the languages in each; sources share equally.
MIX_WEIGHTS = {("d0",): 0.5, ("d1",): 0.3, ("d2",): 0.2} | {(d, lang): w for d in ("d0", "d1", "d2") for lang, w in (("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2))}


@query
def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_sources(docs, mix_levels(), MIX_WEIGHTS, fraction=0.6, epochs=4)
    return mixed.select("doc_id", "lang", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_take").alias("take_tokens"))


@query
def op4_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents"), k=2)


@query
def op6_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op7_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op9_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("chain_pos")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op10_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
