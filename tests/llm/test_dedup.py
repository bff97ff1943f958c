import collections
import hashlib
import random

import numpy as np
import pytest
from util import frame, lower, union_find

from stratalens.llm import line_dedup as lines
from stratalens.llm.embedding_dedup import embedding_dedup
from stratalens.llm.exact_dedup import directory, exact_dedup
from stratalens.llm.minhash import minhash_dedup
from stratalens.llm.substring_dedup import substring_dedup


def test_directory_splits_and_doubles():
    found = directory({p: (50 if p < 4 else 1) for p in range(16)}, 60, 4)
    assert [x[0] for x in found] == list(range(16))
    assert [x[1] for x in found] == sorted(x[1] for x in found)
    assert [x[2] for x in found][:4] == [4] * 4 and found[-1][2] < 4
    assert {x[1] for x in directory({0: 10**9}, 5, 3)} == {0, 1, 2, 3}  # overflow stays in its bucket


@pytest.mark.parametrize("capacity", [3, 20_000])
def test_exact(spark, rows, docs, capacity):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, capacity).collect())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert got == want


def test_exact_edges(spark):
    assert exact_dedup(frame(spark, []).limit(0)).count() == 0
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(frame(spark, [(None, "a"), (4, "A"), (None, "b")])).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}


def brute_near(rows, k):
    sets = {}
    for i, t in rows:
        w = lower(t).encode().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent, find = union_find(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), ids[find(a)]) for a, i in enumerate(ids)}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(rows, docs, k):
    want = brute_near(rows, k)
    got = minhash_dedup(docs, k).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if (r.n_shingles, r.component_id) != want[r.doc_id] or r.kept != (r.doc_id == r.component_id)]
    assert wrong == []


def test_minhash_group_of_mutants(spark):
    """One base in many degrees of change: links beyond the pivot's component are found too."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(250):
        own = list(base)
        for _ in range(rng.randint(0, 22)):
            own[rng.randrange(150)] = f"v{rng.random()}"
        rows.append((i, " ".join(own)))
    want = brute_near(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash_dedup(frame(spark, rows), 2).collect()}
    wrong = sum(got[i] != want[i][1] for i in got)
    assert wrong <= 2, wrong


def test_minhash_edges(spark):
    assert minhash_dedup(frame(spark, []).limit(0)).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup(frame(spark, [(None, "a b c d e f"), (3, None), (2, " "), (1, "a b c d e f")])).collect()}
    assert got == {(None, 2, None, False), (3, 0, 3, True), (2, 0, 2, True), (1, 2, 1, True)}


def brute_windows(rows, w):
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        own = (t or "").encode().split()
        gone = bytearray(len(own))
        for p in range(len(own) - w + 1):
            key = tuple(own[p : p + w])
            if key in seen:
                gone[p : p + w] = b"\1" * w
            seen.setdefault(key, (i, p))
        kept = b" ".join(x for x, c in zip(own, gone, strict=True) if not c)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("w", [10, 20])
def test_substrings(rows, docs, w):
    want = brute_windows(rows, w)
    got = substring_dedup(docs, w).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got if (r.n_words, r.n_removed, r.kept_sha256) != want[r.doc_id]] == []


def test_substring_edges(spark):
    assert substring_dedup(frame(spark, []).limit(0)).count() == 0
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(frame(spark, [(None, "a " * 30), (5, "a " * 30), (6, None)])).collect()}
    assert got == {None: (30, 29), 5: (30, 30), 6: (0, 0)}


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_within(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        rows.append((a, "".join(b)))
    for t in (1, 2, 3):
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        assert [r for r in got if r.w != (lev(r.a, r.b) <= t)] == []


def test_lines(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            s = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            own.append("".join(s)[: rng.choice((10, 1000))])
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1])]
    every = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line:
                every.setdefault(line, (i, n))
    names = list(every)
    parent, find = union_find(len(names))
    linked = set()
    for a in range(len(names)):
        for b in range(a):
            if min(len(names[a]), len(names[b])) >= 20 and abs(len(names[a]) - len(names[b])) <= 2 and lev(names[a], names[b]) <= 2:
                linked |= {a, b}
                parent[find(a)] = find(b)
    first = {}
    for a, line in enumerate(names):
        first[find(a)] = min(first.get(find(a), (1 << 60, 0)), every[line])
    at = {line: a for a, line in enumerate(names)}
    got = {r.doc_id: r for r in lines.line_dedup(frame(spark, rows)).collect()}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for n, x in enumerate(own) if not x or first[find(at[x])] == (i, n)]
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_text) == (len(own), len(own) - len(kept), "\n".join(kept)), i
        assert got[i].n_linked == sum(x != "" and at[x] in linked for x in own)
    assert lines.line_dedup(frame(spark, []).limit(0)).count() == 0


def test_letter_counts_wrap(spark):
    """Counts beyond 15, and with the highest bit set, are compared without overflow."""
    rows = [("s" * 9 + "x" * 30, "s" * 30 + "x" * 9), ("ssss" * 40 + "e", "ssss" * 40 + "ea"), ("r" * 8 + "s" * 8, "q" * 16)]
    df = spark.createDataFrame(rows, "x string, y string")
    packed = lambda c: lines.letter_counts().replace("line", c).replace("(n -", f"(length({c}) -")
    got = df.selectExpr(f"{packed('x')} AS a", f"{packed('y')} AS b").selectExpr(f"{lines.counts_differ('a', 'b')} AS d").collect()
    assert [r.d for r in got] == [5, 1, 16]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(600):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice((0.0, 0.05, 0.12, 0.3))
        rows.append((i, v.tolist(), int(i % 3), "x", 1, 2.0))
    rows += [(700, None, 1, "x", 1, 2.0), (701, [0.0] * 16, 1, "x", 1, 2.0), (702, [float("nan")] + [1.0] * 15, 1, "x", 1, 2.0), (703, [None] + [1.0] * 15, 1, "x", 1, 2.0), (704, rows[0][1], None, "x", 1, 2.0), (705, [1.0], 1, "x", 1, 2.0), (706, [float("inf")] * 16, 1, "x", 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string, size int, leaf double")
    ok = [(r[0], np.array(r[1]), r[2]) for r in rows[:600]]
    parent, find = union_find(600)
    n = [0] * 600
    for a in range(600):
        for b in range(a):
            if ok[a][2] == ok[b][2] and ok[a][1] @ ok[b][1] >= 0.98 * np.linalg.norm(ok[a][1]) * np.linalg.norm(ok[b][1]):
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert all(got[i] == (0, i, True) for i in range(700, 707))
    assert sum(n) > 1000
    assert sum(got[i] != (n[i], find(i), i == find(i)) for i in range(600)) <= 3
    assert embedding_dedup(df.limit(0)).count() == 0
