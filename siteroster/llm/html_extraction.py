"""Main text of web pages: a bidirectional LSTM labels every block in the context of its page.

A block is read as two vectors, side by side: the hashed tags and names of the
path above it, and its hashed words, with a few measures of length and links. Two
LSTMs run over the page's blocks, forward and backward; a logistic output on both
states says whether a block is main text. The model is trained here, in numpy, on
pages that this module writes itself with known labels: articles with menus,
banners, notices, adverts, sidebars, forms, comments and footers of many shapes.

Defined results: null or empty pages, and pages without blocks of main text, have
an empty text; unclosed tags, comments and scripts are read as browsers do, up to
the end of the page; pages of any length are read whole; repeated rows give
repeated rows; null ids and addresses stay null; other columns are not read.
"""

from __future__ import annotations

import html
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteroster.llm.page_blocks import blocks

PATHS, WORDS, MEASURES, HIDDEN = 96, 64, 8, 24
WIDTH = PATHS + WORDS + MEASURES
#: Pages labelled at a time.
TOGETHER = 256


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    pairs = [f"{a}>{b}" for a, b in zip(path, path[1:])]
    places = [zlib.crc32(name.encode()) % PATHS for name in (*path, *pairs[-2:])]
    return np.minimum(np.bincount(places, minlength=PATHS), 2) if places else np.zeros(PATHS)


def features(found: list[tuple[str, tuple[str, ...], float]]) -> np.ndarray:
    """A row per block of one page."""
    n = len(found)
    rows = np.zeros((n, WIDTH), np.float32)
    for i, (text, path, linked) in enumerate(found):
        rows[i, :PATHS] = _path_vector(path)
        words = text.lower().split()
        hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in words), np.int64, len(words))
        rows[i, PATHS:PATHS + WORDS] = np.bincount(hashed, minlength=WORDS) / np.sqrt(len(words))
        rows[i, PATHS + WORDS:] = (
            np.log1p(len(words)) / 3, np.log1p(len(text)) / 5, linked, text[-1] in ".!?…\"»", len(words) < 4,
            "©" in text, i / n, sum(c.isdigit() for c in text[:200]) / 50)
    return rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Two LSTMs and a logistic output; arrays run (step, page, feature)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"out": small(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        for way in ("on", "back"):
            self.p |= {f"{way}_in": small(WIDTH, 4 * HIDDEN) * 0.5, f"{way}_state": small(HIDDEN, 4 * HIDDEN),
                       f"{way}_bias": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def _run(self, way: str, x: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        steps, n, k = x.shape[0], x.shape[1], HIDDEN
        given = x @ self.p[f"{way}_in"] + self.p[f"{way}_bias"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states = np.zeros((steps, n, k), np.float32)
        for t in range(steps) if way == "on" else range(steps - 1, -1, -1):
            sums = given[t] + h @ self.p[f"{way}_state"]
            gates = _sigmoid(sums[:, :3 * k])
            i, f, o, new = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:], np.tanh(sums[:, 3 * k:])
            after = f * c + i * new
            out = np.tanh(after)
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, out))
            mask = real[t][:, None]
            h, c = np.where(mask, o * out, h), np.where(mask, after, c)
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = [self._run(way, x, real, None if keep is None else keep.setdefault(way, [])) for way in ("on", "back")]
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep["both"] = both
        return _sigmoid(both @ self.p["out"] + self.p["out_bias"])

    def gradients(self, x: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[dict, float]:
        keep: dict = {}
        found, k = self.probabilities(x, real, keep), HIDDEN
        n = real.sum()
        d_out = np.where(real, found - labels, 0).astype(np.float32) / n
        loss = -np.where(real, np.log(np.where(labels > 0, found, 1 - found) + 1e-9), 0).sum() / n
        g = {"out": np.einsum("tpk,tp->k", keep["both"], d_out), "out_bias": d_out.sum(keepdims=True).reshape(1)}
        for way, part in (("on", slice(0, k)), ("back", slice(k, 2 * k))):
            d_in = np.zeros((*x.shape[:2], 4 * k), np.float32)
            d_h, d_c = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
            g[f"{way}_state"] = np.zeros_like(self.p[f"{way}_state"])
            for t, h, c, i, f, o, new, out in reversed(keep[way]):
                mask = real[t][:, None]
                total = d_h + d_out[t][:, None] * self.p["out"][part]
                d = np.where(mask, total, 0)
                inner = np.where(mask, d_c, 0) + d * o * (1 - out * out)
                d_sum = np.concatenate([inner * new * i * (1 - i), inner * c * f * (1 - f),
                                        d * out * o * (1 - o), inner * i * (1 - new * new)], axis=1)
                d_in[t] = d_sum
                g[f"{way}_state"] += h.T @ d_sum
                d_h = np.where(mask, d_sum @ self.p[f"{way}_state"].T, total)
                d_c = np.where(mask, inner * f, d_c)
            flat = d_in.reshape(-1, 4 * k)
            g[f"{way}_in"], g[f"{way}_bias"] = x.reshape(-1, WIDTH).T @ flat, flat.sum(axis=0)
        return g, float(loss)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, real = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for i, p in enumerate(pages):
        x[:len(p), i], real[:len(p), i] = p, True
    return x, real


@lru_cache(maxsize=1)
def train(pages: int = 4000, epochs: int = 7, together: int = 25, seed: int = 11) -> Labeller:
    """Adam over pages of the writer below; their number bounds the training set."""
    rng, model = random.Random(seed), Labeller()
    made = []
    for _ in range(pages):
        page, main = written_page(rng)
        found = blocks(page)
        made.append((features(found), np.array([text in main for text, _, _ in found], np.float32)))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, rate = 0, 0.01
    for _ in range(epochs):
        rng.shuffle(made)
        for at in range(0, pages, together):
            part = made[at:at + together]
            x, real = padded([f for f, _ in part])
            labels = np.zeros(real.shape, np.float32)
            for i, (_, wanted) in enumerate(part):
                labels[:len(wanted), i] = wanted
            g, _ = model.gradients(x, real, labels)
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-7)
        rate *= 0.65
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    """Pages of similar numbers of blocks run side by side."""
    found = [blocks(page) for page in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(found[order[end]]) <= 1.3 * len(found[order[at]]) + 4:
            end += 1
        some = order[at:end]
        x, real = padded([features(found[i]) for i in some])
        chosen = model.probabilities(x, real) >= 0.5
        for column, i in enumerate(some):
            texts[i] = " ".join(text for step, (text, _, _) in enumerate(found[i]) if chosen[step, column])
        at = end
    return texts


def extract_main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``."""
    model = model or train()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = main_texts(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")


SYLLABLES = "an be co da en er fi ge ha in ja ka li mo na on pa qui ra se ti un ve wo ar el is ou th sch ung ción ê é ä ö ß".split()
#: Words of page furniture in four languages, as training text for blocks that are not main text.
FURNITURE = ("home menu login register search contact about subscribe newsletter cookies accept privacy terms share tweet "
             "comments reply related tags categories archive advertisement sponsored startseite anmelden suche kontakt "
             "impressum datenschutz anzeige kommentare accueil connexion recherche mentions publicité commentaires "
             "inicio buscar contacto aviso publicidad comentarios").split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3))))


def _prose(rng: random.Random, low: int, high: int) -> str:
    words = [_word(rng) for _ in range(rng.randint(low, high))]
    for i in range(len(words)):
        if rng.random() < 0.12:
            words[i] += rng.choice((".", ",", ".", "?"))
    return " ".join(words).capitalize() + (rng.choice((".", ".", "")) if high > 8 else "")


def _furniture(rng: random.Random) -> str:
    return " ".join(rng.choice(FURNITURE) if rng.random() < 0.6 else _word(rng) for _ in range(rng.randint(1, 5)))


def _named(rng: random.Random, tag: str, names: str, inner: str) -> str:
    given = rng.choice(names.split())
    attribute = rng.choice((f' class="{given}"', f' id="{given}"', f' class="{given} {_word(rng)}"'))
    return f"<{tag}{attribute}>{inner}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    made = [f'<a href="/{_word(rng)}">{_furniture(rng) if rng.random() < 0.5 else _prose(rng, 1, 4)}</a>' for _ in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if rng.random() < 0.7 else " | ".join(made)


def _aside(rng: random.Random) -> str:
    """A piece of page furniture that may stand anywhere."""
    prose = _prose(rng, 3, 30)
    kind = rng.randrange(9)
    if kind == 0:
        return _named(rng, rng.choice(("div", "aside", "section")), "ad ads advert banner promo sponsored advertisement", prose)
    if kind == 1:
        return _named(rng, "div", "cookie cookies notice consent gdpr alert banner popup", f"<p>{prose}</p><button>OK</button>")
    if kind == 2:
        return _named(rng, "div", "share social tools buttons meta toolbar", _links(rng, 3))
    if kind == 3:
        return f"<form><label>{_furniture(rng)}</label><input name=q><p>{prose}</p><button>{_furniture(rng)}</button></form>"
    if kind == 4:
        return _named(rng, rng.choice(("div", "aside")), "sidebar related widget side recommended popular links",
                      f"<h3>{_furniture(rng)}</h3>{_links(rng, rng.randint(2, 6))}<p>{prose}</p>")
    if kind == 5:
        return _named(rng, "div", "newsletter subscribe signup form", f"<h4>{_furniture(rng)}</h4><p>{prose}</p>")
    if kind == 6:
        return f"<aside><p>{prose}</p></aside>"
    if kind == 7:
        return _named(rng, "div", "breadcrumb breadcrumbs crumbs pagination pager", _links(rng, 3))
    return _named(rng, "p", "notice disclaimer ad promo caption", prose)


def _comments(rng: random.Random) -> str:
    each = "".join(_named(rng, rng.choice(("div", "li", "article")), "comment reply response",
                          f"<b>{_word(rng)}</b><p>{_prose(rng, 3, 40)}</p>") for _ in range(rng.randint(1, 5)))
    return _named(rng, rng.choice(("section", "div", "ol")), "comments responses discussion thread comment-list",
                  f"<h3>{_furniture(rng)}</h3>{each}")


def written_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks. Furniture never repeats a main text except by chance."""
    main: list[str] = []
    inner = []

    def add(shape: str, low: int, high: int) -> None:
        text = _prose(rng, low, high)
        roll = rng.random()
        if roll < 0.12:  # lists of words, symbols, repeats, contacts and notices are main text where they stand in it
            text = text.replace(" ", rng.choice((" | ", "### ", " - ", "&&& ", " / ")))
        elif roll < 0.18:
            text = " ".join([_word(rng).capitalize()] * rng.randint(3, 60))
        elif roll < 0.26:
            text += " " + rng.choice((
                f"{_word(rng)}@{_word(rng)}.example.com", f"+{rng.randrange(10 ** 11)}", f"token={rng.randrange(10 ** 20):x}",
                "All rights reserved.", f"Licensed under the {_word(rng)} License.", f"© {_word(rng)}", _furniture(rng)))
        text = text.replace("&&&", "&amp;&amp;")
        main.append(" ".join(html.unescape(text).split()))
        inner.append(shape.format(text))

    if rng.random() < 0.95:
        add(rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>")), 2, 12)
    for _ in range(rng.choice((0, 1, 2, 4, 7, 12))):
        shape = rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<div>{}</div>",
                            "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p>{}</p>", "<table><tr><td>{}</td></tr></table>"))
        add(shape, 2 if rng.random() < 0.2 else 8, 12 if "h2" in shape else 70)
        if rng.random() < 0.08:
            inner.append(_aside(rng))
    body = "".join(inner)
    roll = rng.random()
    if roll < 0.55:
        body = f"<article>{body}</article>"
    elif roll < 0.7:
        body = f"<main>{body}</main>"
    else:
        body = _named(rng, "div", "content article post entry story main text body", body)
    top, bottom = [], []
    if rng.random() < 0.9:
        top.append(f"<nav>{_links(rng, rng.randint(2, 8))}</nav>" if rng.random() < 0.7 else
                   _named(rng, "div", "nav menu navigation navbar header topbar", _links(rng, rng.randint(2, 8))))
    if rng.random() < 0.4:
        top.insert(0, f"<header><div>{_prose(rng, 1, 4)}</div><p>{_prose(rng, 2, 9)}</p></header>")
    top += [_aside(rng) for _ in range(rng.choice((0, 1, 1, 2)))]
    bottom += [_aside(rng) for _ in range(rng.choice((0, 0, 1, 2)))]
    if rng.random() < 0.35:
        bottom.append(_comments(rng))
    if rng.random() < 0.9:
        foot = f"&copy; {_word(rng)}.example &middot; {_prose(rng, 3, 15)}" if rng.random() < 0.7 else _links(rng, 4)
        bottom.append(f"<footer>{foot}</footer>" if rng.random() < 0.7 else _named(rng, "div", "footer foot bottom legal", f"<p>{foot}</p>"))
    return f"<html><body>{''.join(top)}{body}{''.join(bottom)}</body></html>", set(main)
