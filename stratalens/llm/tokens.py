"""Words and token ids of whole texts, computed over Arrow buffers with numpy."""

from __future__ import annotations

import ctypes
import json
import re
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64


#: Bytes of text whose words are hashed at once, about 40 bytes of memory each.
STRETCH = 1 << 20


def tidy(run):
    """run, a function over Arrow batches, giving free memory back to the system when its task ends: workers are kept
    from stage to stage, and one that holds on to what an earlier stage needed leaves less to all later ones."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library: it keeps its free memory
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(4)
def _byte_table(lower: bool, seed: int) -> np.ndarray:
    t = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
    t[SPACE] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


@lru_cache(1)
def _powers() -> np.ndarray:
    p = np.full(4096, 0x9E3779B97F4A7C15, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _power(n: int) -> np.ndarray:
    """The first n powers; those of an unusually long word are not kept."""
    if n <= len(_powers()):
        return _powers()
    p = np.full(n, 0x9E3779B97F4A7C15, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _hashed(buf: np.ndarray, lower: bool, seeds: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the words of a buffer that ends in white space begin, and their hashes for each seed."""
    inside = ~SPACE[buf]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return starts, [np.zeros(0, U64) for _ in seeds]
    spans = np.diff(np.append(starts, len(buf)))
    at = np.arange(starts[0], len(buf)) - np.repeat(starts, spans)
    scale = _power(int(spans.max()) + 1)[at]
    body = buf[starts[0] :]
    return starts, [mix(np.add.reduceat(_byte_table(lower, s)[body] * scale, starts - starts[0])) for s in seeds]


def words(texts: list[bytes], lower: bool = False, seeds: tuple[int, ...] = (1,)) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, once for each seed, and each text's word count."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # the separator is white space: no word spans two texts
    ends_at = np.cumsum(lens + 1)
    starts, hashes, a = [], [], 0
    while a < len(buf):
        b = min(a + STRETCH, len(buf))
        while not SPACE[buf[b - 1]]:  # up to the end of the word
            more = np.flatnonzero(SPACE[buf[b : b + STRETCH]])
            b = b + int(more[0]) + 1 if len(more) else b + STRETCH
        s, h = _hashed(buf[a:b], lower, seeds)
        starts.append(s + a)
        hashes.append(h)
        a = b
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    per = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_at))))
    return [np.concatenate([h[k] for h in hashes]) if hashes else np.zeros(0, U64) for k in range(len(seeds))], per


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """(first, last) index ranges whose texts hold about limit bytes; a longer text is a range of its own."""
    first = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, k
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


# -- the word-level BPE vocabulary ----------------------------------------------------------

#: Words of these characters only: no combining, special-casing or white space to think of. Newlines part words here.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿŒœ¿¡«»\n]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^a-zß-öø-ÿœ0-9\n]+|\n")
#: Stands between the ids of words: no id has these bytes, nor do two neighbours.
APART = b"\xff" * 4


class WordBPE:
    """ids of white-space separated words under a lower-casing BPE vocabulary with word ends.

    No piece of this vocabulary spans white space, so a text's ids are its words' ids in order.
    Plain words are merged for a whole batch at once, lowest rank first in every word; any other
    word, and any that names a special token, goes to the tokenizers library.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        code = left << 17 | right
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.buckets = self._table(self.code)
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}
        self.keep = keep

    def _table(self, codes: np.ndarray):
        """Open addressing with linear probing, 2^19 slots: slot -> index into codes."""
        size = 1 << 19
        slot = np.full(size, -1, np.int64)
        for k, h in enumerate(self._hash(codes).tolist()):
            while slot[h] >= 0:
                h = (h + 1) & (size - 1)
            slot[h] = k
        keys = np.where(slot >= 0, codes[slot], -1)
        return keys, np.where(slot >= 0, self.rank[slot], 1 << 40)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(45)).astype(np.int64)

    def _ranks(self, codes: np.ndarray) -> np.ndarray:
        keys, ranks = self.buckets
        at = self._hash(codes)
        out = np.full(len(codes), 1 << 40, np.int64)
        todo = np.arange(len(codes))
        while len(todo):
            k = keys[at]
            hit = k == codes[todo]
            out[todo[hit]] = ranks[at[hit]]
            more = ~hit & (k >= 0)
            todo, at = todo[more], (at[more] + 1) & (len(keys) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each lower-cased piece."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        sym, ends = self.inner[buf], np.cumsum(lens)
        sym[ends - 1] = self.last[buf[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lens)
        parts = []  # (word, symbols) of words that are done
        none = 1 << 40
        while len(sym):
            code = np.append(sym[:-1] << 17 | sym[1:], 0)
            pair = np.full(len(sym), none, np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            pair[same] = self._ranks(code[same])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            n = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(pair, first), n)
            going = low < none
            if not going.all():
                parts.append((word[~going], sym[~going]))
                sym, word, pair, low = sym[going], word[going], pair[going], low[going]
                if not len(sym):
                    break
            hit = np.flatnonzero(pair == low)
            # in a run of overlapping equal pairs every second one merges
            new = np.concatenate(([True], np.diff(hit) != 1))
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]
            sym[hit] = self.made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        raw = sym[order].astype("<u4").tobytes()
        cut = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(pieces))))) * 4
        cut = cut.tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, missing: list[bytes]) -> None:
        text = b"\n".join(missing).decode("utf-8")
        odd: list[bytes] = []
        if not PLAIN.fullmatch(text) or "<|" in text:
            plain = []
            for w in missing:
                s = w.decode("utf-8")
                (plain if PLAIN.fullmatch(s) and "<|" not in s else odd).append(w)
            missing, text = plain, b"\n".join(plain).decode("utf-8")
        if missing:
            found = PIECES.findall(text.lower())
            distinct = dict.fromkeys(found)
            distinct.pop("\n", None)
            ids = dict(zip(distinct, self.merge([p.encode() for p in distinct]), strict=True)) | {"\n": APART}
            self.cache.update(zip(missing, b"".join(map(ids.__getitem__, found)).split(APART), strict=True))
        for k in range(0, len(odd), 1000):
            for w, e in zip(odd[k : k + 1000], self.slow.encode_batch([w.decode("utf-8") for w in odd[k : k + 1000]], add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a full cache keeps only words that have just come again."""
        out = []
        for a, b in chunks(texts, 2 << 20):
            split = [t.split() for t in texts[a:b]]
            every = set().union(*split)
            missing = every.difference(self.cache)
            if missing:
                if len(self.cache) > self.keep:
                    self.cache = {w: self.cache[w] for w in every - missing}
                self._learn(list(missing))
            out += [b"".join(map(self.cache.__getitem__, s)) for s in split]
        return out


@lru_cache(1)
def word_bpe(path: str) -> WordBPE:
    """One vocabulary a worker process."""
    return WordBPE(path)
