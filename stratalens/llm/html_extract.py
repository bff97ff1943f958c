"""Main-text extraction: a bidirectional LSTM labels every block of a page."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .tokens import chunks, tidy

PATH_DIM, WORD_DIM, NUMBERS = 96, 64, 6
DIM = PATH_DIM + WORD_DIM + NUMBERS
WEIGHTS = Path(__file__).with_name("html_weights.npz")

# Elements whose content is no text, that hold nothing, and that do not begin a block.
RAW = frozenset("script style noscript template svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]{0,60}")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[a-z]+")

#: Steps times pages that are labelled at once, and of a longer page the steps that are.
CELLS = 1 << 13


class _Ends:
    """Where things end on a page, each found in time linear in the page however malformed it is: a search that has failed
    once is not made again, and once a tag has run to the end of the page all other ends come from one table."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()
        self.table: tuple[list[int], list[int]] | None = None

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, at: int) -> int:
        """The first > at or after at that is not between quotes, or -1; a quote that is never closed is an ordinary character."""
        if self.table is not None:
            places, ends = self.table
            k = bisect_left(places, at)
            return ends[k] if k < len(ends) else -1
        while True:
            close = self.find(">", at)
            if close < 0:
                return -1
            quote = SPECIAL.search(self.page, at).start()
            if quote == close:
                return close
            shut = self.find(self.page[quote], quote + 1)
            at = (quote if shut < 0 else shut) + 1
            if self.find(">", at) < 0:
                self._tabulate()
                self.missing.discard(">")
                return -1

    def _tabulate(self) -> None:
        places = [m.start() for m in SPECIAL.finditer(self.page)]
        ends, after = [-1] * (len(places) + 1), {}
        for k in range(len(places) - 1, -1, -1):
            c = self.page[places[k]]
            ends[k] = places[k] if c == ">" else ends[after.get(c, k) + 1]
            after[c] = k
        self.table = places, ends[:-1]


def blocks(page: str) -> list[tuple[str, tuple[str, ...], float, bytes]]:
    """(text, last path tokens, share of its characters in links, path) of each block in page order.

    A block is the text between two block-level tags. References are decoded, white space becomes one
    space. Path tokens are the names of the open elements and the words of their classes, ids and roles; path
    tells which of their hashed places are taken. Time and memory are linear in the page.
    """
    out: list[tuple[str, tuple[str, ...], float, bytes]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter[str] = Counter()
    taken = [0] * PATH_DIM
    ends = _Ends(page)
    held: list[str] = []
    linked = chars = links = 0

    def flush() -> None:
        nonlocal linked, chars
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            last = [t for name, more in stack[-2:] for t in (name, *more)]
            out.append((text, tuple(last[-2:]), linked / max(chars, 1), bytes(map(bool, taken))))
        held.clear()
        linked = chars = 0

    def pop() -> None:
        name, more = stack.pop()
        open_[name] -= 1
        for t in (name, *more):
            taken[_slot(t, PATH_DIM)] -= 1

    at, end = 0, len(page)
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            held.append(page[at:stop])
            chars += stop - at
            linked += stop - at if links else 0
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = ends.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            stop = ends.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        closing = page.startswith("/", at + 1)
        m = NAME.match(page, at + 1 + closing)
        stop = ends.tag(m.end()) if m else -1
        if stop < 0:
            held.append("<")
            chars += 1
            linked += 1 if links else 0
            at += 1
            continue
        name, rest = m[0].lower(), page[m.end() : stop]
        at = stop + 1
        if name in RAW and not closing:
            close = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = close.start() if close else end
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        flush()
        if closing:
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "option", "dd", "dt", "td", "tr")):
                pop()
            more = tuple(w for v in ATTRIBUTE.findall(rest) for w in LETTERS.findall("".join(v).lower())) if rest else ()
            stack.append((name, more))
            open_[name] += 1
            for t in (name, *more):
                taken[_slot(t, PATH_DIM)] += 1
            links = 0
    flush()
    return out


@lru_cache(1 << 16)
def _slot(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % dim


@lru_cache(1 << 14)
def _path_vector(path: bytes, last: tuple[str, ...]) -> np.ndarray:
    v = np.frombuffer(path, np.uint8).astype(np.float32)
    for t in last:
        v[_slot("last " + t, PATH_DIM)] += 1
    return v


def features(found: list[tuple[str, tuple[str, ...], float, bytes]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row per block: its path, all its words (hashed), and its size and shape. found may be a stretch of a page of total
    blocks, from its block `first` on."""
    x = np.zeros((len(found), DIM), np.float32)
    total = len(found) if total is None else total
    for k, (text, last, linked, path) in enumerate(found):
        x[k, :PATH_DIM] = _path_vector(path, last)
        own = text.split(" ")
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_slot(w, WORD_DIM) for w in own], minlength=WORD_DIM) / np.sqrt(len(own))
        x[k, -NUMBERS:] = (np.log1p(len(text)) / 8, np.log1p(len(own)) / 6, linked, sum(map(text.count, ".,;:!?")) / len(own), (first + k) / total, 1 / total)
    return x


def forward(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """LSTM over x (time, batch, DIM); masked steps hand their state on. Gates in order: input, forget, output, cell.
    state, if given, holds h and c before the first step, and is set to those after the last."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    h, c = state or (np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32))
    into = (x.reshape(-1, x.shape[2]) @ w + b).reshape(steps, batch, -1)
    out = np.zeros((steps, batch, size), np.float32)
    for t in range(steps):
        z = into[t] + h @ u
        s = 1 / (1 + np.exp(-z[:, : 3 * size]))
        g = np.tanh(z[:, 3 * size :])
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        c2 = f * c + i * g
        th = np.tanh(c2)
        h2 = o * th
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        h, c = np.where(m, h2, h), np.where(m, c2, c)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


@lru_cache(1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k] for k in z.files}


def logits(pages: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's blocks, positive where a block is main text. Pages of like length share a batch of at most CELLS steps
    in all."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: -len(pages[k]))
    a = 0
    while a < len(order):
        steps = len(pages[order[a]])
        own = order[a : a + max(1, CELLS // steps)]
        a += len(own)
        x = np.zeros((steps, len(own), DIM), np.float32)
        mask = np.zeros((steps, len(own)), bool)
        for j, k in enumerate(own):
            x[: len(pages[k]), j] = pages[k]
            mask[: len(pages[k]), j] = True
        right = forward(x, mask, p["w1"], p["u1"], p["b1"])
        left = forward(x[::-1], mask[::-1], p["w2"], p["u2"], p["b2"])[::-1]
        y = np.concatenate((right, left), axis=2) @ p["v"] + p["c"]
        for j, k in enumerate(own):
            out[k] = y[: len(pages[k]), j, 0]
    return out


def long_logits(found: list, p: dict[str, np.ndarray]) -> np.ndarray:
    """logits of one long page, in stretches that hand their state on: features are never held for the whole page."""
    n, size = len(found), len(p["u1"])
    y = np.full(n, p["c"][0], np.float32)
    cuts = [(a, min(a + CELLS, n)) for a in range(0, n, CELLS)]
    for way, w, u, b, v in ((1, "w1", "u1", "b1", p["v"][:size]), (-1, "w2", "u2", "b2", p["v"][size:])):
        state = [np.zeros((1, size), np.float32), np.zeros((1, size), np.float32)]
        for a, z in cuts[::way]:
            x = features(found[a:z], a, n)[::way, None, :]
            h = forward(x, np.ones((z - a, 1), bool), p[w], p[u], p[b], state=state)
            y[a:z] += (h[:, 0] @ v)[::way, 0]
    return y


def main_texts(pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    p = weights()
    said = logits([features(f) if len(f) <= CELLS else features([]) for f in found], p)
    said = [s if len(f) <= CELLS else long_logits(f, p) for f, s in zip(found, said, strict=True)]
    return ["\n".join(b[0] for b, y in zip(f, s, strict=True) if y > 0) for f, s in zip(found, said, strict=True)]


def _extract(batches):
    for batch in batches:
        texts: list[str] = []
        pages = [p or "" for p in batch.column(2).to_pylist()]
        for a, b in chunks(pages):
            texts += main_texts(pages[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    text is the blocks labelled as main text, in page order, joined by newlines; nothing of a page is dropped
    or capped otherwise. A null or empty page, or one without main text, gives an empty text. Repeated rows
    are extracted each; other columns are ignored; an empty table gives an empty result. Pages never meet:
    there is no shuffle. A task labels about a million characters of pages at a time, or one longer page, whose blocks it
    labels in stretches; scanning is linear in the page, however malformed.
    """
    return in_arrow(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string")), tidy(_extract), pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
