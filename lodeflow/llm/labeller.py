"""HTML extraction by a recurrent block labeller.

A page's leaf blocks are a sequence. Each is read as the sum of the vectors of its hashed tag-path names, the mean vector of its
hashed words and four figures (length, share of links, closing mark, a constant). A bidirectional LSTM in numpy runs over the
whole page, so that each block is classified as main text or not with all of the page in view; what is kept is joined in page
order.

The model is trained when first used, on pages that a seeded generator makes: articles of invented words in many layouts,
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, each block marked with what it is. No
row of the input takes part. The sizes of the training (pages, turns) are parameters; the same ones give the same model.

Defined cases: a null or empty page, and one without main text, gives an empty text; text outside all elements is a block;
rows that repeat are read each for themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeflow.llm.blocks import Block, blocks
from lodeflow.llm.common import arrow_map, texts

NAMES, WORDS = 1024, 1024
NAME_DIM, WORD_DIM, FIGURES, HIDDEN = 16, 8, 4, 16
SCALE = 4.0
INPUT = NAME_DIM + WORD_DIM + FIGURES
CACHE = 1 << 18


class _Buckets(dict):
    """Hash buckets of words, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return h


_buckets = _Buckets()


@lru_cache(1 << 14)
def _path(path: tuple[str, ...]) -> np.ndarray:
    """Buckets of a path's names; the names of the last element count as such, too."""
    last = max((i for i, n in enumerate(path) if n[0] == "<"), default=0)
    return np.array([zlib.crc32(n.encode()) % NAMES for n in [*dict.fromkeys(path), *(f"!{n}" for n in path[last:])]] or [0], np.int64)


def _inputs(p: dict[str, np.ndarray], names: np.ndarray, n_names: np.ndarray, words: np.ndarray, n_words: np.ndarray, figures: np.ndarray) -> np.ndarray:
    """Each block's vector: the scaled sum of its names' rows, the mean of its words' rows, and its figures."""
    runs = lambda table, places, sizes: np.add.reduceat(table[places], np.cumsum(sizes) - sizes)
    return np.concatenate([runs(p["names"], names, n_names) / SCALE, runs(p["words"], words, n_words) / n_words[:, None], figures], axis=1)


def read(found: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name places with their numbers, word places with theirs, and the figures of blocks."""
    paths = [_path(b.path) for b in found]
    words = [b.text.lower().split() for b in found]
    n_names = np.array(list(map(len, paths)), np.int64)
    n_words = np.array(list(map(len, words)), np.int64)
    at = np.fromiter(map(_buckets.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
    figures = np.array([(np.log1p(len(b.text)) / 6, min(1.0, b.linked / len(b.text)), float(b.text[-1] in ".!?:;\"”»"), 1.0) for b in found]).reshape(-1, FIGURES)
    return np.concatenate(paths), n_names, at, n_words, figures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (sequences, steps, HIDDEN) over x (sequences, steps, inputs); ``keep`` gets what the way back needs."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out = np.empty((n, steps, HIDDEN))
    ahead = x @ w[: x.shape[2]] + b
    for t in range(steps):
        z = ahead[:, t] + h @ w[x.shape[2] :]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[:, t] = h
    return out


def lstm_back(x: np.ndarray, w: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x, w and b from those of the hidden states."""
    n, steps, size = x.shape
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    dz_all, dw_h = np.empty((n, steps, 4 * HIDDEN)), np.zeros((HIDDEN, 4 * HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[:, t] = dz
        dw_h += h.T @ dz
        dh, dc = dz @ w[size:].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ w[:size].T, np.concatenate([x.reshape(-1, size).T @ flat, dw_h]), flat.sum(axis=0)


def _turned(steps: int, lengths: np.ndarray) -> np.ndarray:
    """Places that read each sequence from its end; what lies behind it stays."""
    t = np.arange(steps)
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


@dataclass
class Labeller:
    """Parameters by name."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    def vectors(self, found: list[Block]) -> np.ndarray:
        return _inputs(self.p, *read(found))

    def main(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            steps = len(pages[order[-1]])
            n = max(1, min(256, (1 << 14) // steps))
            part, order = order[-n:], order[:-n]
            lengths = np.array([len(pages[i]) for i in part])
            x = np.zeros((len(part), steps, INPUT))
            x[np.arange(steps) < lengths[:, None]] = self.vectors([b for i in part for b in pages[i]])
            score = self._score(x, lengths)
            for k, i in enumerate(part):
                out[i] = _sigmoid(score[k, : len(pages[i])])
        return out

    def _score(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p, turn = self.p, _turned(x.shape[1], lengths)
        back = np.take_along_axis(x, turn[:, :, None], 1)
        kept: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        a, b = lstm(x, p["wf"], p["bf"], kept[0]), lstm(back, p["wb"], p["bb"], kept[1])
        all_in = np.concatenate([a, np.take_along_axis(b, turn[:, :, None], 1), x], axis=2)
        if keep is not None:
            keep |= {"turn": turn, "back": back, "kept": kept, "in": all_in}
        return all_in @ p["wo"] + p["bo"]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """The mean loss over the blocks, the parameters' gradients and that of x."""
        keep: dict = {}
        score = self._score(x, lengths, keep)
        mask = np.arange(x.shape[1]) < lengths[:, None]
        p = _sigmoid(score)
        d = np.where(mask, p - y, 0.0) / mask.sum()
        loss = -float(np.where(mask, np.log(np.where(y > 0.5, p, 1 - p) + 1e-12), 0.0).sum()) / mask.sum()
        d_in = d[:, :, None] * self.p["wo"]
        turn = keep["turn"][:, :, None]
        xa, wf, bf = lstm_back(x, self.p["wf"], keep["kept"][0], d_in[:, :, :HIDDEN])
        xb, wb, bb = lstm_back(keep["back"], self.p["wb"], keep["kept"][1], np.take_along_axis(d_in[:, :, HIDDEN : 2 * HIDDEN], turn, 1))
        dx = d_in[:, :, 2 * HIDDEN :] + xa + np.take_along_axis(xb, turn, 1)
        return loss, {"wf": wf, "bf": bf, "wb": wb, "bb": bb, "wo": np.einsum("nt,nth->h", d, keep["in"]), "bo": np.array(d.sum())}, dx


def fresh(seed: int) -> Labeller:
    rng = np.random.default_rng(seed)
    w = lambda *shape: rng.normal(0, 0.2, shape)
    bias = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return Labeller({"names": w(NAMES, NAME_DIM), "words": np.zeros((WORDS, WORD_DIM)), "wf": w(INPUT + HIDDEN, 4 * HIDDEN), "bf": bias.copy(), "wb": w(INPUT + HIDDEN, 4 * HIDDEN), "bb": bias.copy(), "wo": w(2 * HIDDEN + INPUT), "bo": np.array(0.0)})


def fit(pages: list[list[tuple[Block, bool]]], *, turns: int = 8, rate: float = 0.01, size: int = 32, seed: int = 1) -> Labeller:
    """A labeller trained by Adam on pages of marked blocks."""
    model, rng = fresh(seed), random.Random(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    order, step = [p for p in pages if p], 0
    for turn in range(turns):
        rng.shuffle(order)
        for s in range(0, len(order), size):
            part = order[s : s + size]
            lengths = np.array(list(map(len, part)))
            mask = np.arange(lengths.max()) < lengths[:, None]
            flat = [b for p in part for b, _ in p]
            names, n_names, words, n_words, figures = read(flat)
            x, y = np.zeros((*mask.shape, INPUT)), np.zeros(mask.shape)
            x[mask] = _inputs(model.p, names, n_names, words, n_words, figures)
            y[mask] = [float(good) for p in part for _, good in p]
            _, g, dx = model.gradients(x, lengths, y)
            own = dx[mask]
            for key, places, sizes, each, rows in (("names", names, n_names, own[:, :NAME_DIM] / SCALE, NAMES), ("words", words, n_words, own[:, NAME_DIM : NAME_DIM + WORD_DIM] / n_words[:, None], WORDS)):
                each = np.repeat(each, sizes, axis=0)
                g[key] = np.stack([np.bincount(places, each[:, k], rows) for k in range(each.shape[1])], axis=1)
            step += 1
            now = rate * (1 - 0.9 * turn / turns)
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v**2
                model.p[k] = model.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


# fixed values: names and words that pages commonly use for their parts
PART_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs links toolbar tabs topnav mainmenu submenu sitemap",
    "header": "header masthead banner top topbar logo branding site title tagline",
    "footer": "footer foot bottom copyright legal colophon credits contentinfo",
    "sidebar": "sidebar side aside widget rail related recommended trending popular more tags archive complementary latest",
    "notice": "cookie cookies notice consent alert gdpr popup modal overlay message warning announcement privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adbox adsense banner commercial teaser",
    "form": "form search login signup newsletter subscribe contact register feedback poll",
    "comments": "comments comment discussion disqus reply replies respond responses reader commentlist thread reviews",
    "share": "share social sharing follow buttons print tools",
    "main": "content post entry article story body text main prose blog single news hentry field",
    "plain": "page wrapper container column section inner row col block box wrap outer layout center left right grid area clearfix",
}
PART_WORDS = {
    "menu": "home about contact news sports politics business culture science menu start kontakt accueil inicio archive blog shop help",
    "header": "daily times journal portal news magazine welcome login search skip to content subscribe",
    "footer": "copyright © all rights reserved privacy policy terms imprint impressum contact · mentions légales aviso legal",
    "sidebar": "related articles popular posts recent tags most read more from trending recommended categories archives",
    "notice": "we use cookies this site uses cookies accept consent privacy settings please note javascript enable",
    "advert": "advertisement sponsored buy now sale discount offer free shipping anzeige publicité click here limited",
    "form": "name email message send search subscribe newsletter sign up password enter your address submit",
    "comments": "comment comments reply says wrote posted by ago like dislike report thanks agree user guest",
    "share": "share tweet facebook email print follow us whatsapp pin linkedin",
}
SYLLABLES = "an ar be cha de el en er fo ge ha in is ka la li ma ne no on or pa qui ra re sa sch se ta te ti tion un ver vi zu é ó ü".split()
MARK = "⁣"


class Pages:
    """Seeded pages of marked blocks."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3, 4))))

    def invented(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        odd = self.rng.random()
        if odd < 0.05:
            words = [words[0]] * len(words)
        elif odd < 0.1:
            words = [x for w in words for x in (w, self.rng.choice(("|", "-", "·", "#", "!!")))]
        for i in range(len(words)):
            if self.rng.random() < 0.1:
                words[i] += self.rng.choice((".", ",", "."))
        return " ".join(words).capitalize() + self.rng.choice((".", ".", ".", "", "?", ":"))

    def phrase(self, part: str) -> str:
        """Words of a part, mixed with invented ones, or invented ones only."""
        own = PART_WORDS[part].split()
        how = self.rng.random()
        if how < 0.45:
            return self.invented(1, self.rng.choice((2, 5, 12, 40)))
        words = self.rng.choices(own, k=self.rng.randint(1, 6))
        return " ".join(words + [self.word() for _ in range(self.rng.choice((0, 0, 2, 8)))])

    def names(self, part: str) -> str:
        """A class or id attribute, or none."""
        rng = self.rng
        if rng.random() < 0.15:
            return ""
        made = self.own(part, rng.choice((1, 1, 2)))
        if rng.random() < 0.3:
            made.append(rng.choice(PART_NAMES["plain"].split()))
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(("-", " ", "_")).join(made)}"'

    def own(self, part: str, n: int) -> list[str]:
        """Names of a part; those listed first are the more common ones."""
        all_names = PART_NAMES[part].split()
        return list(dict.fromkeys(self.rng.choices(all_names, [1 / (k + 1) for k in range(len(all_names))], k=n)))

    def sure(self, part: str) -> str:
        return self.names(part) or f' class="{self.own(part, 1)[0]}"'

    def links(self, part: str) -> str:
        rng = self.rng
        items = [f'<a href="/{self.word()}">{self.phrase(part) if rng.random() < 0.5 else self.word()}</a>' for _ in range(rng.randint(1, 8))]
        how = rng.random()
        if how < 0.6:
            return f"<ul{self.names('plain') if rng.random() < 0.2 else ''}>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def part(self, part: str) -> str:
        """A part that isn't main text."""
        rng = self.rng
        tag, sure = {"menu": ("nav", 0.6), "header": ("header", 0.5), "footer": ("footer", 0.6), "sidebar": ("aside", 0.6)}.get(part, ("", 0.0))
        if part == "form":
            body = "".join(f"<label>{self.phrase('form')}</label><input name={self.word()}>" + rng.choice(("", "<br>", "<p>")) for _ in range(rng.randint(1, 3))) + rng.choice(("", "<button>ok</button>"))
            return f"<form{self.names('form')}>{body}</form>"
        if part == "comments":
            one = lambda: rng.choice((f"<p>{self.phrase('comments')}</p>", "")) + f"<p>{self.invented(2, 60)}</p>"
            each = rng.choice(("div", "li", "article", "div"))
            body = rng.choice(("", f"<h3>{self.phrase('comments')}</h3>", f"<h2>{self.phrase('comments')}</h2>")) + "".join(f"<{each}{self.names('comments')}>{one()}</{each}>" for _ in range(rng.randint(1, 5)))
            return f"<{(t := rng.choice(('div', 'section', 'div', 'ol', 'aside')))}{self.sure('comments')}>{body}</{t}>"
        if part in ("menu", "share"):
            body = self.links(part)
        elif part == "header":
            body = rng.choice((f"<h1>{self.phrase(part)}</h1>", f"<div>{self.phrase(part)}</div>", f"<p>{self.phrase(part)}</p>", self.links("menu"), f"<a href=/>{self.phrase(part)}</a>"))
        elif part == "sidebar":
            body = rng.choice(("", f"<h3>{self.phrase(part)}</h3>", f"<h2>{self.phrase(part)}</h2>")) + rng.choice((self.links(part), f"<p>{self.invented(3, 40)}</p>", f"<div>{self.phrase(part)}</div>"))
        else:
            body = rng.choice((f"<p>{self.phrase(part)}</p>", self.phrase(part), f"<div>{self.phrase(part)}</div>", self.phrase(part) + self.links(part)))
        if tag and rng.random() < sure:
            return f"<{tag}{self.names(part) if rng.random() < 0.5 else ''}>{body}</{tag}>"
        t = rng.choice(("div", "div", "section"))
        return f"<{t}{self.sure(part)}>{body}</{t}>"

    def said(self) -> str:
        """A block's own text, marked as main text."""
        rng = self.rng
        text = MARK + self.invented(1, rng.choice((1, 2, 8, 30, 90)))
        if rng.random() < 0.2:
            text = text.replace(" ", f" <{(t := rng.choice(('b', 'i', 'em', 'a href=/x', 'span')))}>", 1) + f"</{t.split()[0]}>"
        return text

    def piece(self) -> str:
        rng, how = self.rng, self.rng.random()
        if how < 0.6:
            return f"<p{self.names('plain') if rng.random() < 0.05 else ''}>{self.said()}" + rng.choice(("</p>", "</p>", "</p>", ""))
        if how < 0.72:
            h = rng.choice(("h2", "h3", "h4"))
            return f"<{h}>{self.said()}</{h}>"
        if how < 0.8:
            t = rng.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li>{self.said()}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if how < 0.85:
            return f"<blockquote>{rng.choice((self.said(), f'<p>{self.said()}</p>'))}</blockquote>"
        if how < 0.9:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.said()}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        if how < 0.93:
            return f"<figure><img src=x><figcaption>{self.said()}</figcaption></figure>"
        if how < 0.95:
            return f"<pre>{self.said()}</pre>"
        return f"<div>{self.said()}</div>"

    def article(self) -> str:
        rng = self.rng
        inside = ["advert", "advert", "share", "sidebar", "notice", "form"]
        head = rng.choice((f"<h1>{self.said()}</h1>", f"<h1>{self.said()}</h1>", f"<header><h1>{self.said()}</h1></header>", f"<h2>{self.said()}</h2>", ""))
        body = [self.piece() for _ in range(rng.choice((1, 2, 4, 8, 16, 30)))]
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            body.insert(rng.randint(0, len(body)), self.part(rng.choice(inside)))
        if rng.random() < 0.15:
            body.append(self.part("comments"))
        inner = head + "".join(body)
        how = rng.random()
        if how < 0.5:
            out = f"<article{self.names('main') if rng.random() < 0.4 else ''}>{inner}</article>"
        elif how < 0.6:
            out = f"<main{self.names('main') if rng.random() < 0.4 else ''}>{inner}</main>"
        elif how < 0.85:
            t = rng.choice(("div", "div", "section"))
            out = f"<{t}{self.sure('main')}>{inner}</{t}>"
        elif how < 0.9:
            out = f"<table><tr><td{self.names('plain')}>{self.links('menu')}<td{self.names('main')}>{inner}</table>"
        else:
            out = inner
        if rng.random() < 0.3:
            t = rng.choice(("main", "div", "section", "form"))
            out = f"<{t}{self.names(rng.choice(('main', 'plain')))}>{out}</{t}>"
        return out

    def page(self) -> str:
        rng = self.rng
        some = lambda *parts: "".join(self.part(p) for p in parts if rng.random() < 0.45)
        before = ["header", "menu", "notice", "advert", "form", "advert"]
        after = ["comments", "share", "sidebar", "advert", "form", "notice", "advert", "footer"]
        if rng.random() < 0.3:
            rng.shuffle(before)
        middle = [self.article()]
        if rng.random() < 0.25:
            middle.insert(rng.randint(0, 1), self.part("sidebar"))
        body = some(*before) + "".join(middle) + some(*after)
        for _ in range(rng.choice((0, 0, 1, 2))):
            t = rng.choice(("div", "div", "section"))
            body = f"<{t}{self.names('plain')}>{body}</{t}>"
        return f"<html><head><title>{self.word()}</title></head><body{self.names('plain') if rng.random() < 0.2 else ''}>{body}</body></html>"

    def marked(self) -> list[tuple[Block, bool]]:
        out = []
        for b in blocks(self.page()):
            text = b.text.replace(MARK, "").strip()
            if text:
                out.append((Block(b.path, text, min(b.linked, len(text))), MARK in b.text))
        return out


@lru_cache(2)
def trained(pages: int = 2400, turns: int = 4, seed: int = 1) -> Labeller:
    """The labeller of a number of generated pages."""
    made = Pages(seed)
    return fit([made.marked() for _ in range(pages)], turns=turns, seed=seed)


def main_text(page: list[Block], p: np.ndarray) -> str:
    return "\n\n".join(b.text for b, x in zip(page, p, strict=True) if x >= 0.5)


def extracted(pages: DataFrame, model: Callable[[], Labeller] = trained) -> DataFrame:
    """page_id, url, text and n_chars for each row of (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(x.decode("utf-8", "replace")) for x in texts(b.column(2))]
        out = [main_text(page, p) for page, p in zip(found, shared.value.main(found), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, f, f"page_id {kind}, url string, text string, n_chars long")
