"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, in_arrow_batches
from .tokens import chunks, tidy

UND = "und"
PROFILE = 400  # most frequent n-grams kept of a language and of a document
CHUNK = 1 << 18  # characters counted at once: about 150 bytes of memory each
LONGEST = 3  # n-grams of 1 to 3 characters; words are padded with one blank on either side


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 where it is no letter."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, n-gram code) of every n-gram occurrence, and the alphabet of the codes.

    Codes order n-grams by length, then by code points, whatever the alphabet of these texts.
    """
    joined = "\n".join(texts) + "\n"
    sym = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    blank = sym == 0
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    sym, doc = np.concatenate((np.zeros(1, np.uint32), sym[keep])), np.concatenate(([0], doc[keep]))
    seen = np.bincount(sym, minlength=1) > 0
    alphabet = np.flatnonzero(seen)
    code = (np.cumsum(seen) - 1)[sym].astype(np.int64)
    k = len(alphabet)
    letter = np.flatnonzero(code > 0)
    docs, codes = [doc[letter]], [code[letter]]
    at = np.arange(len(code) - 1)
    two = at[(code[at] > 0) | (code[at + 1] > 0)]
    docs.append(doc[two + 1])
    codes.append(k + code[two] * k + code[two + 1])
    mid = letter[letter < len(code) - 1]
    docs.append(doc[mid])
    codes.append(k + k * k + (code[mid - 1] * k + code[mid]) * k + code[mid + 1])
    return np.concatenate(docs), np.concatenate(codes), alphabet


def _names(codes: np.ndarray, alphabet: np.ndarray) -> list[str]:
    k = len(alphabet)
    char = [" ", *map(chr, alphabet[1:].tolist())]
    out = []
    for c in codes.tolist():
        if c < k:
            out.append(char[c])
        elif c < k + k * k:
            out.append(char[(c - k) // k] + char[(c - k) % k])
        else:
            c -= k + k * k
            out.append(char[c // (k * k)] + char[c // k % k] + char[c % k])
    return out


def _packed(g: str) -> int:
    """An n-gram as one number, 21 bits a character from the right: numbers order as codes do, in any alphabet."""
    out = 0
    for c in g:
        out = out << 21 | (1 if c == " " else ord(c) + 1)
    return out


def _unpacked(code: int) -> str:
    own = [code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]
    return "".join(" " if c == 1 else chr(c - 1) for c in own if c)


def long_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of one long text, sorted, and their counts: stretch by stretch, so that memory is bounded by the
    stretch and by the number of distinct n-grams. An n-gram belongs to the stretch in which it ends."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.ones(1, np.int64)  # the last two symbols: 1 for a blank, else letter + 1
    for at in range(0, len(text) + 1, CHUNK):
        part = text[at : at + CHUNK] + (" " if at + CHUNK > len(text) else "")
        sym = _fold()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64) + 1
        last = np.concatenate((before[-1:], sym[:-1]))
        sym = np.concatenate((before, sym[(sym > 1) | (last > 1)]))
        new = np.arange(len(before), len(sym))
        x, y = sym[new], sym[new - 1]
        found = [x[x > 1], (y << 21 | x)[(x > 1) | (y > 1)]]
        new = new[new >= 2]
        x, y, z = sym[new], sym[new - 1], sym[new - 2]
        found.append((z << 42 | y << 21 | x)[y > 1])
        own, n = np.unique(np.concatenate(found), return_counts=True)
        every = np.concatenate((codes, own))
        codes, where = np.unique(every, return_inverse=True)
        counts = np.bincount(where, np.concatenate((counts, n)), len(codes)).astype(np.int64)
        before = sym[-2:]
    return codes, counts


def _count(batches):
    """Partial n-gram counts by language; handed on whenever a task holds many."""
    held: dict[str, Counter] = {}

    def rows():
        flat = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    for batch in batches:
        texts, langs = (batch.column(c).to_pylist() for c in (0, 1))
        for a, b in chunks(texts, CHUNK):
            if len(texts[a]) > CHUNK:
                codes, n = long_grams(texts[a])
                held.setdefault(langs[a], Counter()).update(dict(zip(map(_unpacked, codes.tolist()), n.tolist(), strict=True)))
                continue
            doc, code, alphabet = grams(texts[a:b])
            own = sorted(set(langs[a:b]))
            which = np.array([own.index(x) for x in langs[a:b]], np.int64)
            span = len(alphabet) + len(alphabet) ** 2 + len(alphabet) ** 3
            key = which[doc] * span + code
            if span * len(own) <= 1 << 20:
                n = np.bincount(key, minlength=1)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            names = _names(key % span, alphabet)
            for lang, g, x in zip((key // span).tolist(), names, n.tolist(), strict=True):
                held.setdefault(own[lang], Counter())[g] += x
        if sum(map(len, held.values())) > 200_000:
            yield rows()
    yield rows()


def profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, over every row of docs; size rows a language come to the driver."""
    src = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    n = in_arrow(src, tidy(_count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    found: dict[str, list[str]] = {}
    for r in n.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


def _predictor(learned: dict[str, list[str]], size: int):
    """A function from texts to their languages and scores."""
    langs = sorted(learned)
    every = sorted({g for p in learned.values() for g in p})
    place = {g: k for k, g in enumerate(every)}
    ranks = np.full((len(every) + 1, len(langs)), size, np.int64)  # a missing n-gram is size places out
    for k, lang in enumerate(langs):
        for r, g in enumerate(learned[lang]):
            ranks[place[g], k] = r
    absent = ranks == size
    packed = np.array([_packed(g) for g in every], np.int64)
    by_packed = np.argsort(packed)

    def known(alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the profiles' n-grams in this alphabet, sorted, and their rows in ranks."""
        k, at = len(alphabet), {c: i for i, c in enumerate(alphabet.tolist())} | {32: 0}
        pairs = []
        for row, g in enumerate(every):
            own = [at.get(ord(c), -1) for c in g]
            if min(own) >= 0:
                pairs.append(((own[0], k + own[0] * k + own[-1], k + k * k + (own[0] * k + own[len(own) // 2]) * k + own[-1])[len(g) - 1], row))
        pairs.sort()
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, place, row in ranks) of each text's most frequent n-grams."""
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            code, n = long_grams(texts[0])
            code = code[np.lexsort((code, -n))[:size]]
            doc, rank, have, row = np.zeros(len(code), np.int64), np.arange(len(code)), packed[by_packed], by_packed
        else:
            doc, code, alphabet = grams(texts)
            span = len(alphabet) + len(alphabet) ** 2 + len(alphabet) ** 3
            key = np.sort(doc * span + code)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
            n = np.diff(np.append(first, len(key)))
            doc, code = key[first] // span, key[first] % span
            order = np.lexsort((code, -n, doc))
            doc, code = doc[order], code[order]
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
            rank = np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))
            top = rank < size
            doc, code, rank = doc[top], code[top], rank[top]
            have, row = known(alphabet)
        if not len(have):
            return doc, rank, np.full(len(code), len(every))
        at = np.minimum(np.searchsorted(have, code), len(have) - 1)
        return doc, rank, np.where(have[at] == code, row[at], len(every))

    def predict(texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
        for a, b in chunks(texts, CHUNK):
            doc, rank, at = ranked(texts[a:b])
            if not len(doc) or not langs:
                continue
            out = np.where(absent[at], size, np.abs(ranks[at] - rank[:, None]))
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            far = np.add.reduceat(out, start, axis=0)
            best = far.argmin(axis=1)
            lang[a + doc[start]] = best
            score[a + doc[start]] = 1 - far[np.arange(len(start)), best] / (size * np.diff(np.append(start, len(doc))))
        return [langs[k] if k >= 0 else UND for k in lang.tolist()], score

    return predict


def _predict(learned: dict[str, list[str]], size: int):
    def run(batches):
        predict = _predictor(learned, size)
        for batch in batches:
            said, score = predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2: such documents teach nothing. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, from its whole text.

    Profiles are learned from all documents of train (docs by default) that are not held out and have a
    text and a language; nothing but the text enters a prediction. A null text, or one without letters,
    is `und` with score 0, and so is every text if no language was learned. Ties go to the language whose
    name sorts first; the score is 1 less the share of the largest possible distance. Repeated rows are
    predicted each; an empty table gives an empty result; other columns are ignored.
    """
    seen = (docs if train is None else train).where(~held_out(id_col))
    learned = profiles(seen, text_col, lang_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = in_arrow(src, tidy(_predict(learned, PROFILE)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text is in some language, that is, not `und`; all columns, whatever their names.

    Only the text goes to Python, and only the language comes back: the rows themselves stay in the JVM. Null texts,
    and texts without letters, go; null ids and repeated rows are judged each; an empty table gives an empty result.
    """
    learned = profiles(docs.where(~held_out(id_col)), text_col, lang_col)

    def said(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = _predictor(learned, PROFILE)
        yield from tidy(lambda held: (pa.array(predict([t or "" for t in own.to_pylist()])[0], pa.string()) for own in held))(arrays)

    language = F.arrow_udf(said, "string")
    in_arrow_batches(docs.sparkSession)
    return docs.where(language(F.col(text_col).cast("string")) != UND)
