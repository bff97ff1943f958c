"""Training of the block labeller on generated pages: python -m stratalens.llm.html_train writes html_weights.npz."""

from __future__ import annotations

import random
import re

import numpy as np

from .html_extract import DIM, PATH_DIM, WEIGHTS, WORD_DIM, blocks, features, forward

SIZE = 16

# What the generator builds words and page furniture from.
SYLLABLES = "an ber chi da el fou ger hin ier jo ka lle men nor ou pra qui re sch tion ul ver wa xi yes zu é ñ ó ß".split()
CONTENT = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<div class="entry">', '<div class="article-text">', '<section class="story">', '<main role="main"><article>', "<div>"]
NOISE = [
    "<nav>", "<header>", "<footer>", "<aside>", "<form>", '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="banner">', '<div class="cookie-notice">',
    '<div id="consent">', '<div class="notice">', '<div class="sidebar">', '<div id="menu">', '<ul class="menu">', '<div class="share">', '<div class="social">', '<div class="related">',
    '<div class="promo">', '<div class="newsletter">', '<div class="breadcrumbs">', '<div class="footer">', '<div class="header">', '<div class="nav">', '<div class="popup">', '<div class="widget">',
    '<section id="comments">', '<div class="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="login"><form>', '<div role="navigation">', '<div class="subscribe">',
]

PLAIN = "wrap wrapper container inner outer row col grid page site layout body block box clearfix section".split()
ABOUT = "article content post entry story text main body copy news single prose page-content article-body post-content entry-content story-body".split()
COMMON = "the of and to in a is that it for was on with as by at from der die und in den von zu das mit sich des auf le la les et des en un une du que pour dans el los de y que en un por con para".split()
LABELS = "Menu Home Search Login Subscribe Share Comments Reply Related Newsletter Archive Contact Imprint Privacy Terms Next Previous Accept Cookies Advertisement Sponsored Follow Tweet Print Tags".split()


def _close(opened: str) -> str:
    names = [x.split()[0].strip("<>") for x in opened.replace("><", ">\n<").split("\n")]
    return "".join(f"</{n}>" for n in reversed(names))


def sample(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its main blocks."""
    truth: list[str] = []
    count = 0

    common = rng.random() * 0.6

    def named(tag: str, names: list[str]) -> str:
        """The tag with up to three classes, and now and then an id."""
        own = [rng.choice(names), *rng.sample(PLAIN, rng.randint(0, 2))]
        kind = rng.random()
        return f"<{tag}>" if kind < 0.2 else f'<{tag} id="{own[0]}">' if kind < 0.35 else f'<{tag} class="{" ".join(own)}">'

    def words(n: int) -> str:
        nonlocal count
        count += 1
        own = [rng.choice(COMMON) if rng.random() < common else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        for k in range(0, n, rng.randint(6, 14)):
            own[k] = own[k].capitalize()
        if rng.random() < 0.1:
            own = [w + rng.choice(("%%%", "***", "&amp;&amp;", "!!")) for w in own]
        return " ".join(own) + rng.choice((".", "", "!", f" {count}"))

    def noise(inside: bool = False) -> str:
        opened = rng.choice(NOISE)
        if rng.random() < 0.3:
            opened = opened[:-1].replace('class="', f'class="{rng.choice(PLAIN)} ') + ">"
        kind = rng.random()
        if rng.random() < 0.3:
            opened += f"<{(head := rng.choice(('h2', 'h3', 'h4', 'div')))}>{rng.choice(LABELS)}</{head}>"
        if kind < 0.4:
            body = "<ul>" + "".join(f'<li><a href="/{k}">{words(rng.randint(1, 3))}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"
        elif kind < 0.6:
            body = words(rng.randint(2, 25))
        elif kind < 0.9:
            body = "".join(f"<p>{words(rng.randint(3, 60))}</p>" for _ in range(rng.randint(1, 4)))
        else:
            body = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button><select><option>{words(1)}<option>{words(2)}</select>"
        return opened + body + _close(re.sub(r"<(h2|h3|h4|div)>\w+</\1>$", "", opened))

    def paragraph() -> str:
        text = words(rng.choice((1, 3, 8, 20, 60, 150, 300)))
        truth.append(text)
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{text}</p>"
        if kind < 0.8:
            return f"<p><b>{text}<br>"
        if kind < 0.85:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.92:
            return f"<ul><li>{text}</li></ul>"
        return f"<h2>{text}</h2>"

    out = [f"<!DOCTYPE html><html><head><title>{words(6)}</title><style>p{{}}</style></head><body>"]
    out += [noise() for _ in range(rng.randint(0, 4))]
    opened = rng.choice(CONTENT[:2] * 6 + CONTENT)
    if rng.random() < 0.6:
        # any nesting of neutral and of telling elements, one of them telling
        inside = [named(rng.choice(("main", "article", "section", "div")), ABOUT) for _ in range(rng.randint(1, 2))]
        opened = "".join([named("div", PLAIN) for _ in range(rng.randint(0, 2))] + [rng.choice(("<main>", "<article>", '<div class="content">'))] * (rng.random() < 0.7) + inside)
    wrap = rng.random() < 0.3
    out.append('<div class="page">' if wrap else "")
    out.append(opened)
    if rng.random() < 0.7:
        title = words(rng.randint(2, 12))
        truth.append(title)
        out.append(f"<h1>{title}</h1>")
    for _ in range(rng.randint(1, 14)):
        out.append(paragraph())
        if rng.random() < 0.08:
            out.append(noise(True))
    out.append(_close(opened) + ("</div>" if wrap else ""))
    out += [noise() for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.7:
        out.append(f"<footer>&copy; {words(rng.randint(2, 20))}</footer>")
    if rng.random() < 0.9:
        out.append("</body></html>")
    return "".join(out), truth


def labelled(seed: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    import html

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page, truth = sample(rng)
        main = {" ".join(html.unescape(t).split()) for t in truth}
        found = blocks(page)
        out.append((features(found), np.array([b[0] in main for b in found], np.float32)))
    return out


def _backward(x: np.ndarray, kept: list, u: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u and b, from those of the outputs."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    dw, du, db = np.zeros((x.shape[2], 4 * size), np.float32), np.zeros_like(u), np.zeros(4 * size, np.float32)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, th, m = kept[t]
        dh = dh + into[t]
        own = dh * m
        inner = dc * m + own * o * (1 - th * th)
        dz = np.concatenate((inner * g * i * (1 - i), inner * c * f * (1 - f), own * th * o * (1 - o), inner * i * (1 - g * g)), axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dh * ~m + dz @ u.T, dc * ~m + inner * f
    return dw, du, db


def train(seed: int = 1, pages: int = 12000, epochs: int = 6, batch: int = 32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w1": draw(DIM, 4 * SIZE), "u1": draw(SIZE, 4 * SIZE), "b1": np.zeros(4 * SIZE, np.float32), "w2": draw(DIM, 4 * SIZE), "u2": draw(SIZE, 4 * SIZE), "b2": np.zeros(4 * SIZE, np.float32), "v": draw(2 * SIZE, 1), "c": np.zeros(1, np.float32)}
    first, second, step = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2)), None, 0
    first, second = first
    data = labelled(seed, pages)
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), batch):
            own = [data[k] for k in order[a : a + batch]]
            steps = max(len(y) for _, y in own)
            x, y, mask = np.zeros((steps, len(own), DIM), np.float32), np.zeros((steps, len(own)), np.float32), np.zeros((steps, len(own)), bool)
            for j, (xs, ys) in enumerate(own):
                x[: len(ys), j], y[: len(ys), j], mask[: len(ys), j] = xs, ys, True
            # places of the vectors are left out at random, so that no single class or word decides
            x[:, :, : PATH_DIM + WORD_DIM] *= rng.random((1, len(own), PATH_DIM + WORD_DIM)) > 0.1
            k1, k2 = [], []
            h1 = forward(x, mask, p["w1"], p["u1"], p["b1"], k1)
            h2 = forward(x[::-1], mask[::-1], p["w2"], p["u2"], p["b2"], k2)[::-1]
            h = np.concatenate((h1, h2), axis=2)
            out = 1 / (1 + np.exp(-(h @ p["v"] + p["c"])[:, :, 0]))
            dy = ((out - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            dh = dy @ p["v"].T
            grads = {"v": np.tensordot(h, dy, ((0, 1), (0, 1))), "c": dy.sum(axis=(0, 1))}
            grads["w1"], grads["u1"], grads["b1"] = _backward(x, k1, p["u1"], dh[:, :, :SIZE])
            grads["w2"], grads["u2"], grads["b2"] = _backward(x[::-1], k2, p["u2"], dh[::-1, :, SIZE:])
            step += 1
            rate = 0.01 * (1 if epoch < epochs - 2 else 0.2)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def accuracy(p: dict[str, np.ndarray], seed: int = 99, pages: int = 500) -> float:
    from .html_extract import logits

    data = labelled(seed, pages)
    said = logits([x for x, _ in data], p)
    right = sum(int(((s > 0) == (y > 0)).sum()) for s, (_, y) in zip(said, data, strict=True))
    return right / sum(len(y) for _, y in data)


if __name__ == "__main__":
    found = train()
    np.savez_compressed(WEIGHTS, **found)
    print(accuracy(found))
