"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next stage's docs. All but the last return the columns of documents. Nothing is dropped but by a stage's
own decision: texts in no language, exact copies, near copies, and documents beyond their source's budget.
Every stage takes an empty table, null or repeated ids, null texts, and extra columns of any name.
"""

import public_tokenizers

from stratalens.llm.common import save
from stratalens.llm.exact_dedup import drop_copies
from stratalens.llm.language_id import keep_identified
from stratalens.llm.minhash import drop_near_copies
from stratalens.llm.mixing import mix_sources
from stratalens.llm.packing import best_fit_pack
from stratalens.llm.queries import MIX_WEIGHTS, mix_levels
from stratalens.session import table

#: No SQL: profiles, MinHash, budgets and packing are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark, docs, sf_dir):
    """Documents whose text is in some language stay; null texts and those without letters go."""
    return keep_identified(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts one row stays, that with the largest doc_id. Null ids lose to any other; rows that share an id
    with other texts are judged by their own."""
    return drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of documents linked by five-word shingles, similarity 0.8 or more, one row stays, that with the smallest doc_id;
    null ids come last."""
    return drop_near_copies(docs, k=5)


def mixing(spark, docs, sf_dir):
    """Sources at their weights within 60 % of all tokens; one epoch, so that no copy comes back; documents stay whole.
    Null languages and sources are children of their own; rows without tokens are never chosen."""
    return mix_sources(docs, mix_levels(), MIX_WEIGHTS, fraction=0.6, epochs=1).select(*docs.columns)


def packing(spark, docs, sf_dir):
    """Sequences of at most 4096 tokens; a null text is one end token. Workers serve all stages, so few words are cached."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=150_000)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]


def run(spark, sf_dir):
    """All stages over the whole documents table; what each returns is a stage table for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
