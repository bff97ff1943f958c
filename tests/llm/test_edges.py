"""Null ids, repeated ids and rows, long texts, empty tables and clashing names, for what the other tests leave out."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from util import frame, words

import corpus_pipeline
from stratalens.llm import language_id, line_dedup, mixing, packing
from stratalens.llm.embedding_dedup import embedding_dedup
from stratalens.llm.exact_dedup import drop_copies
from stratalens.llm.minhash import drop_near_copies
from stratalens.llm.substring_dedup import substring_dedup

LONG = " ".join(f"word{k % 977} été{k % 13}" for k in range(60_000))


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_copies_go_by_row(spark):
    rows = [(1, "same text here"), (2, "same text here"), (1, "another unique text"), (None, "Three"), (None, "three"), (9, "THREE"), (None, "alone"), (None, "alone"), (5, None), (6, ""), (7, "x"), (7, "x")]
    got = drop_copies(frame(spark, rows))
    assert kept(got) == sorted([(2, "same text here"), (1, "another unique text"), (9, "THREE"), (None, "alone"), (6, ""), (7, "x")], key=str)
    assert got.columns == frame(spark, rows).columns
    assert drop_copies(frame(spark, []).limit(0)).count() == 0


def test_near_copies_go_by_row(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base + " end"
    rows = [(1, base), (2, near), (1, "quite another text of more than five words"), (None, base + " x"), (None, "only null ids have these six words"), (None, "only null ids have these six words"), (5, None), (5, None), (6, " "), (7, "short"), (8, "short")]
    got = drop_near_copies(frame(spark, rows))
    assert kept(got) == sorted([(1, base), (1, "quite another text of more than five words"), (None, "only null ids have these six words"), (5, None), (5, None), (6, " "), (7, "short")], key=str)
    assert got.columns == frame(spark, rows).columns
    assert drop_near_copies(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("rows, fraction, total", [([(1, "w " * 10), (1, "w " * 10)], 0.5, 10), ([(None, "w " * 10)] * 10, 0.5, 50), ([(k % 3, "v " * (k % 7 + 1)) for k in range(60)], 0.37, None)])
def test_mixing_never_exceeds_its_budget(spark, rows, fraction, total):
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4).withColumnRenamed("key", "_level0").withColumnRenamed("size", "_u")
    got = mixing.mix_sources(docs, {"source": F.col("source")}, {}, fraction, epochs=1)
    assert got.columns == [*docs.columns, "_epoch", "_tokens", "_take"]
    want = int(fraction * sum(len(t.split()) for _, t in rows))
    assert total in (None, want)
    assert got.agg(F.sum("_take")).first()[0] == want
    assert got.where("_take > _tokens OR _take <= 0").count() == 0


def test_budgets_of_many_leaves():
    held = {(f"d{k % 7}", f"s{k}"): k % 50 + 1 for k in range(20_000)}
    got = mixing.budgets(held, {("d1",): 3.0}, 100_000, 1)
    assert sum(got.values()) == 100_000 and all(got[p] <= n for p, n in held.items())


def test_long_texts_have_the_same_language(spark, monkeypatch):
    """A text longer than a chunk is counted in stretches, to the same n-grams."""
    rng = random.Random(2)
    text = "".join(rng.choice("abé ÄZ  日1!\n") for _ in range(4000))
    doc, code, alphabet = language_id.grams([text])
    want = collections.Counter(language_id._names(code, alphabet))
    for size in (1, 2, 7, 1000, 3999, 4000, 4001):
        monkeypatch.setattr(language_id, "CHUNK", size)
        codes, n = language_id.long_grams(text)
        assert dict(zip(map(language_id._unpacked, codes.tolist()), n.tolist(), strict=True)) == want
        assert [language_id._packed(language_id._unpacked(c)) for c in codes.tolist()] == codes.tolist()
    learned = {"x": ["a", "b", " a"], "y": ["é", "ä"]}
    monkeypatch.setattr(language_id, "CHUNK", 1 << 18)
    whole = language_id._predictor(learned, 10)([text, "ä é", "12", "b a"])
    monkeypatch.setattr(language_id, "CHUNK", 64)
    parts = language_id._predictor(learned, 10)([text, "ä é", "12", "b a"])
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_language_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "abc abd", "a", None), (1, "xyz xyw", "b", None), (1, "xyz xyw", "b", None), (None, None, "a", None)]
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in language_id.identify_language(frame(spark, rows)).collect())
    assert got == [("1", False, "b"), ("1", False, "b"), ("None", False, "a"), ("None", False, "und")]


def test_packing_of_a_long_text(spark):
    ids = [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(LONG, add_special_tokens=False).ids, 1]
    got = sorted((r.piece, r.start, r.length) for r in packing.best_fit_pack(frame(spark, [(1, LONG)]), public_tokenizers.path("word_bpe_49k.json")).collect())
    assert got == [(k, k * 4096, min(4096, len(ids) - k * 4096)) for k in range(-(-len(ids) // 4096))]


def test_lines_of_null_ids_repeated_rows_and_long_lines(spark):
    line = "a long line that two documents share "
    long = "x" * 30_000
    rows = [(None, f"{line}\none"), (3, f"{line}\n{long}a"), (3, f"{line}\n{long}a"), (4, f"{long}b\n{line[:-2]}y "), (5, "")]
    got = sorted(((str(r.doc_id), r.n_lines, r.n_linked, r.n_removed, len(r.kept_text)) for r in line_dedup.line_dedup(frame(spark, rows)).collect()))
    assert got == [("3", 2, 2, 1, 30_001), ("3", 2, 2, 1, 30_001), ("4", 2, 2, 2, 0), ("5", 1, 0, 0, 0), ("None", 2, 1, 0, len(line) + 4)]


def test_lines_of_a_hot_group(spark, monkeypatch):
    """Variants of one line, more than a block: all are one group, by way of few links."""
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rng = random.Random(9)
    base = list("the quick brown fox jumps over the lazy dog again and again")
    lines = {"".join(base)}
    while len(lines) < 150:
        own = list(base)
        own[rng.randrange(len(own))] = rng.choice("0123456789")
        lines.add("".join(own))
    rows = [(k, t) for k, t in enumerate(sorted(lines))]
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == [0]
    assert all(r.n_linked == 1 for r in got)


def test_substrings_of_repeated_ids(spark):
    rows = [(1, "a b c " * 10), (1, "a b c " * 10), (None, LONG), (2, LONG)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == [("1", 30, 27), ("1", 30, 27), ("2", 120_000, 120_000), ("None", 120_000, got[3][2])]


def test_embeddings_of_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [0.999, 0.001], "x")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("None", 0, "None", False)]


def test_stages_take_awkward_tables(spark, tmp_path):
    """Each stage on an empty table, and on null and repeated ids with columns of clashing names."""
    rng = random.Random(3)
    text = " ".join(words(rng, 40))
    rows = [(1, text, "en", "s", 0), (1, text + " more", "en", "s", 0), (None, text, "en", None, 0), (None, None, None, None, 0), (4, "", "en", "s", 0), (4, "12", "en", "s", 0), (5, " ".join(words(rng, 50)), None, "s", 0)]
    extra = ["_maybe", "_bucket", "_bit", "_words", "_row", "_id", "_t", "_sha", "_keep", "_d", "_size", "_u"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            assert out.where("_maybe <> '_maybe' OR _u <> '_u'").count() == 0
    after = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, after, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
    assert kept(after) == sorted([(1, text), (5, rows[-1][1])], key=str)
