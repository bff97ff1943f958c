"""Fixtures of the operators' tests: documents with every awkward case, and plain brute force."""

import random

CLASH = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, size string, h int, g int, d string, t1 string, starts int, label int, component long, kept string, uid int, bucket string"
WORDS = [a + b for a in "ba ke lo mi nu ra si to ve wu".split() for b in "n r s t x ng lk".split()]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, "k", 1, None, 2, 3, "x", None, 4, 5, 6, None, 7, "b") for r in rows]
    return spark.createDataFrame(full, CLASH)


def corpus(seed=7, n=120):
    """Copies, near copies of many degrees, shared passages, runs of one word, nulls, empties, ties and repeated rows."""
    rng = random.Random(seed)
    rows, base, passage = [], words(rng, 90), words(rng, 60)
    for k in range(n):
        own = words(rng, rng.choice((1, 2, 5, 40, 90, 200)))
        kind = k % 6
        if kind == 0:
            own = list(base)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
        elif kind == 1:
            own = own + passage[rng.randint(0, 5) :] + words(rng, 5)
        elif kind == 2:
            own = own[:3] + ["same"] * rng.randint(10, 60) + own[3:]
        text = " ".join(own)
        rows.append((k * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    rows += [(1000 + k, rows[k % 7][1]) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "  \t\n "), (2003, "one"), (2004, "One"), (2005, None), (2006, "x " * 3000), (2007, "été \U0001f642 nbsp \x1cfs"), (2007, "été \U0001f642 nbsp \x1cfs")]
    rng.shuffle(rows)
    return rows


def lower(t):
    return (t or "").encode().lower().decode()


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return parent, find
