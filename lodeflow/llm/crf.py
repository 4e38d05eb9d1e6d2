"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are figures of the line in classes (symbols, capitals, repeated words, words seen in earlier lines, lengths
and so on), the same figures of the lines before and after it, and the step from the label before. Documents hand their label
to all of their lines for training. A document's quality is the mean over its lines of the marginal probability of "good",
found by the forward-backward algorithm and weighted by the lines' lengths.

The model is fitted on at most ``most_documents`` labelled documents, those with the least hash of their id, whatever their
length: a document is cut into chains of ``chain_lines`` lines, and of more than ``most_chains`` chains those at even distances
are taken. Figures are made on the executors, so that only classes, 14 bytes a line, reach the driver: 22 MB at most by default.
Every document is scored whole. Labels are used for fitting only. The settings of the fit are those that ``chosen`` found by a
fold inside the training rows; rows that are held out had no part in it.

Defined cases: a null or empty text is one empty line; labels that are null or contradict each other aren't used; without
labelled rows, or with one label only, every score is that label's share (a half without any); rows that repeat are scored
each for themselves; a very long text is scored line by line in one piece; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.common import arrow_map, texts

_CAPITALS, _SMALL, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS, _MARKS, _HIGH = b"#*$%&|<>", b"!?", bytes(range(128, 256))
_SHARES = np.array([0.005, 0.03, 0.1, 0.25, 0.5, 0.75, 0.95])
_FEW = np.array([0.02, 0.1, 0.25, 0.45, 0.7, 0.95, 1.5])
_LENGTHS = np.array([2.5, 3.5, 4.5, 5.5, 7, 9, 14])
_COUNTS = np.array([0.5, 1.5, 3.5, 7.5, 15.5, 40.5, 120.5])
#: figures of a line and the limits of their classes
FIGURES: tuple[tuple[str, np.ndarray], ...] = (
    ("symbols a word", _FEW), ("capitals of letters", _SHARES), ("marks a word", _FEW), ("different words of words", _SHARES),
    ("characters a word", _LENGTHS), ("digits of characters", _SHARES), ("words", _COUNTS), ("equal to an earlier line", np.array([0.5])),
    ("words seen in earlier lines", _SHARES), ("beyond ASCII", _SHARES), ("words equal to the one before", _SHARES), ("full stops a word", _FEW),
    ("longest word", np.array([3.5, 8.5, 14.5, 20.5, 30.5, 60.5, 200.5])), ("words of few letters", _SHARES),
)
CLASSES = 8
#: Adam's turns and rate, and the penalty, as ``chosen`` found them
TURNS, RATE, RIDGE = 150, 0.1, 1e-5
WIDTH = len(FIGURES) * CLASSES


def figures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The figures of each line of a text (lines, figures), and the lines' weights."""
    rows, weights = [], []
    seen_lines: set[bytes] = set()
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        n, own, size = max(1, len(words)), set(words), max(1, len(line))
        capitals = len(line) - len(line.translate(None, _CAPITALS))
        letters = capitals + len(line) - len(line.translate(None, _SMALL))
        lengths = list(map(len, words))
        rows.append((
            (len(line) - len(line.translate(None, _SYMBOLS))) / n, capitals / max(1, letters), (len(line) - len(line.translate(None, _MARKS))) / n, len(own) / n,
            sum(lengths) / n, (len(line) - len(line.translate(None, _DIGITS))) / size, len(words), float(line in seen_lines and bool(words)),
            len(own & seen) / max(1, len(own)), (len(line) - len(line.translate(None, _HIGH))) / size, sum(a == b for a, b in pairwise(words)) / n, line.count(b".") / n,
            max(lengths, default=0), sum(k < 4 for k in lengths) / n,
        ))
        weights.append(size)
        seen_lines.add(line)
        seen |= own
    return np.array(rows), np.array(weights, float)


def classed(rows: np.ndarray) -> np.ndarray:
    """The feature of each figure, as a place among WIDTH."""
    return np.stack([np.searchsorted(limits, rows[:, k]) + k * CLASSES for k, (_, limits) in enumerate(FIGURES)], axis=1)


@dataclass(frozen=True)
class Model:
    """Log-odds of "good" for features of the line, the one before and the one after; scores of starts and of steps."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    edge: np.ndarray  # no line before, no line after
    start: np.ndarray
    step: np.ndarray  # [label before, label]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each line, from its classes."""
        out = self.own[x].sum(axis=1)
        out[1:] += self.before[x[:-1]].sum(axis=1)
        out[:-1] += self.after[x[1:]].sum(axis=1)
        out[0] += self.edge[0]
        out[-1] += self.edge[1]
        return out


def marginals(e: np.ndarray, mask: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many chains at once: e (chains, lines) are log-odds, mask says which lines there are.

    Returns the marginals of "good", the expected steps (2, 2) and the log partition of each chain.
    """
    n, length = e.shape
    score = np.stack([np.zeros_like(e), e], axis=2)
    a = np.zeros((n, length, 2))
    a[:, 0] = start + score[:, 0]
    for t in range(1, length):
        new = np.logaddexp(a[:, t - 1, 0, None] + step[0], a[:, t - 1, 1, None] + step[1]) + score[:, t]
        a[:, t] = np.where(mask[:, t, None], new, a[:, t - 1])
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    b = np.zeros((n, length, 2))
    for t in range(length - 2, -1, -1):
        x = score[:, t + 1] + b[:, t + 1]
        new = np.logaddexp(x[:, 0, None] + step[:, 0], x[:, 1, None] + step[:, 1])
        b[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    p = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None])
    joint = a[:, :-1, :, None] + step + (score + b)[:, 1:, None, :] - z[:, None, None, None]
    return p, np.exp(np.where(mask[:, 1:, None, None], joint, -np.inf)).sum(axis=(0, 1)), z


def fit(docs: list[np.ndarray], labels: list[int], *, turns: int = TURNS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """The model of most penalised likelihood, found by Adam; docs are classes by line (see ``classed``), labels 0 or 1."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    chunks = []
    for s in range(0, len(order), 256):
        part = [docs[i] for i in order[s : s + 256]]
        y = np.array([labels[i] for i in order[s : s + 256]], float)
        length = len(part[0])
        x = np.full((len(part), length + 2, len(FIGURES)), 2 * WIDTH, np.int64)  # a place whose weight stays 0
        mask = np.zeros((len(part), length), bool)
        for k, rows in enumerate(part):
            x[k, 1 : len(rows) + 1] = rows
            mask[k, : len(rows)] = True
        chunks.append((x, mask, y))
    lines = sum(int(m.sum()) for _, m, _ in chunks)
    sizes = [WIDTH, WIDTH, WIDTH, 2, 2, 4]
    cut = np.cumsum(sizes)[:-1]
    w, m1, m2 = np.zeros(sum(sizes)), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    for turn in range(1, turns + 1):
        own, before, after, edge, start, step = np.split(w, cut)
        step = step.reshape(2, 2)
        g = [np.zeros(s) for s in sizes]
        pad = lambda v: np.concatenate([v, np.zeros(WIDTH + 1)])
        for x, mask, y in chunks:
            n = mask.sum(axis=1)
            e = pad(own)[x[:, 1:-1]].sum(axis=2) + pad(before)[x[:, :-2]].sum(axis=2) + pad(after)[x[:, 2:]].sum(axis=2)
            last = np.arange(len(n)), n - 1
            e[:, 0] += edge[0]
            e[last] += edge[1]
            e = np.where(mask, e, 0.0)
            p, joint, _ = marginals(e, mask, start, step)
            d = np.where(mask, y[:, None] - p, 0.0)
            for k, at in enumerate((x[:, 1:-1], x[:, :-2], x[:, 2:])):
                g[k] += np.bincount(at.ravel(), np.broadcast_to(d[:, :, None], at.shape).ravel(), 2 * WIDTH + 1)[:WIDTH]
            g[3] += (d[:, 0].sum(), d[last].sum())
            g[4] += (d[:, 0].sum() * -1, d[:, 0].sum())
            observed = np.zeros((2, 2))
            observed[0, 0], observed[1, 1] = ((n - 1) * (1 - y)).sum(), ((n - 1) * y).sum()
            g[5] += (observed - joint).ravel()
        grad = np.concatenate(g) / lines - ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w = w + rate * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.999**turn)) + 1e-8)
    own, before, after, edge, start, step = np.split(w, cut)
    return Model(own, before, after, edge, start, step.reshape(2, 2))


def constant(share: float) -> Model:
    """A model that gives every line the same marginal."""
    odds = np.log(share / (1 - share))
    none = np.zeros(WIDTH)
    return Model(np.concatenate([np.full(CLASSES, odds), np.zeros(WIDTH - CLASSES)]), none, none, np.zeros(2), np.zeros(2), np.zeros((2, 2)))


def line_marginals(model: Model, found: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The marginals of "good" of each text's lines; texts of near lengths go through the recurrences together."""
    out: list[np.ndarray] = [np.empty(0)] * len(found)
    order = sorted(range(len(found)), key=lambda i: len(found[i][0]))
    while order:
        longest = len(found[order[-1]][0])
        n = max(1, min(256, (1 << 18) // longest))
        part = order[-n:]
        del order[-n:]
        e = np.zeros((len(part), longest))
        mask = np.zeros((len(part), longest), bool)
        for k, i in enumerate(part):
            e[k, : len(found[i][0])] = model.emissions(classed(found[i][0]))
            mask[k, : len(found[i][0])] = True
        p = marginals(e, mask, model.start, model.step)[0]
        for k, i in enumerate(part):
            out[i] = p[k, : len(found[i][0])]
    return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept out of fitting: crc32 of the id as text leaves the remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def chains(docs: DataFrame, labels: DataFrame, *, most_documents: int = 3000, chain_lines: int = 64, most_chains: int = 8) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, classes by line) of the chains of a bounded sample of the labelled rows that aren't held out."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents).select("doc_id", "quality")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # most_documents rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
            x = classed(figures(text)[0]).astype(np.uint8)
            starts = range(0, len(x), chain_lines)
            if len(starts) > most_chains:
                starts = [starts[k * len(starts) // most_chains] for k in range(most_chains)]
            out += [(i, y, s, x[s : s + chain_lines].tobytes()) for s in starts]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "quality", "start", "classes"])

    cast = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    found = sorted(tuple(r) for r in arrow_map(cast, f, "doc_id long, quality int, start long, classes binary").collect())
    return [(i, y, np.frombuffer(x, np.uint8).reshape(-1, len(FIGURES)).astype(np.int64)) for i, y, _, x in found]


def chosen(found: list[tuple[int, int, np.ndarray]], settings: list[dict]) -> tuple[dict, list[float]]:
    """The setting with the least log loss on a fold inside the training rows, and all losses; chains count by their lines."""
    apart = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in found]
    train, test = ([x for x, a in zip(found, apart, strict=True) if a == side] for side in (False, True))
    losses = []
    for setting in settings:
        model, loss, lines = fit([x for _, _, x in train], [y for _, y, _ in train], **setting), 0.0, 0
        for _, y, x in test:
            p = float(marginals(model.emissions(x)[None], np.ones((1, len(x)), bool), model.start, model.step)[0].mean())
            loss -= len(x) * np.log(np.clip(p if y else 1 - p, 1e-6, 1))
            lines += len(x)
        losses.append(float(loss) / max(1, lines))
    return settings[int(np.argmin(losses))], losses


def trained(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """The model of the chains that ``chains`` takes with these options."""
    found = chains(docs, labels, **options)
    y = [label for _, label, _ in found]
    if len(set(y)) < 2:
        return constant((sum(y) + 0.5) / (len(y) + 1))
    return fit([x for _, _, x in found], y)


def scored(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines and n_bad_lines for each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [figures(t) for t in texts(b.column(1))]
        each = line_marginals(shared.value, found)
        score = [min(1.0, max(0.0, float(np.average(p, weights=w)))) for p, (_, w) in zip(each, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(score), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(map(len, each), pa.int64()), pa.array([int((p < 0.5).sum()) for p in each], pa.int64())],
            ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"],
        )

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return arrow_map(rows, f, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long")


def labelled_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0), text, good (the marginal) and label for each line of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(b.column(1))
        each = line_marginals(shared.value, [figures(t) for t in found])
        lines = [t.decode("utf-8", "replace").split("\n") for t in found]
        sizes = list(map(len, lines))
        good = np.concatenate([*each, np.empty(0)])
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array([i for n in sizes for i in range(n)], pa.int64()), pa.array([x for ls in lines for x in ls], pa.string()), pa.array(good), pa.array(np.where(good >= 0.5, "good", "bad"), pa.string())],
            ["doc_id", "line", "text", "good", "label"],
        )

    rows = docs.select("doc_id", "text")
    return arrow_map(rows, f, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, text string, good double, label string")
