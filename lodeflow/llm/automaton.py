"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and texts are lower-cased (A-Z) and cut into runs of ASCII letters, digits and non-ASCII characters. The automaton of
all items is built once and broadcast; texts stream through it, and the longest match that ends at each word says which words
lie in a window of ``window`` item words (or in a whole shorter item). Words and pairs of words that no item holds end a match
anyway, so only stretches without them are walked.

The items are the only data that is broadcast. Their words are counted first: beyond ``most_words`` they are dealt into parts
below that bound and the texts pass through one automaton after another, so the result is the same at any size.

Defined cases: null texts and items have no words; an item without words has no window; repeated items and rows count each
for themselves; a null item id is left out of the list of ids; an empty table of texts gives no rows, and without items nothing
is hit; very long texts stream through in one piece, in time linear in their words; other columns pass through, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeflow.llm.common import arrow_map, free_name, pieces, stored, texts

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_PLAIN).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """A suffix automaton of many word sequences with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary = _Vocabulary()
        self.length, self.link, self.next = [0], [-1], [{}]
        self.whole: dict[int, dict[int, set[str]]] = {}
        self.inside: dict[int, set[str]] = {}
        pairs: set[int] = set()
        self.least = window
        seqs = []
        for name, own in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
            if ids:
                seqs.append((name, ids))
                self.least = min(self.least, len(ids))
                pairs.update(a << 32 | b for a, b in zip(ids, ids[1:], strict=False))
                last = 0
                for i in ids:
                    last = self._extend(last, i)
        self.pairs = np.array(sorted(pairs), np.int64)
        for name, ids in seqs:
            state, n = 0, 0
            for i in ids:
                state, n = self.next[state][i], n + 1
                if n >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    n = min(n, self.length[state])
                    self.inside.setdefault(state, set()).update([name] if name is not None else [])
            if len(ids) < window:
                self.whole.setdefault(state, {}).setdefault(len(ids), set()).update([name] if name is not None else [])

    def _extend(self, last: int, word: int) -> int:
        length, link, following = self.length, self.link, self.next
        if word in following[last]:
            q = following[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def walk(self, ids: list[int], at: int, runs: list[list[int]], names: set[str]) -> None:
        """Stream the words that stand from ``at`` on: hit stretches [start, end) are added to ``runs``, items to ``names``."""
        length, link, following, window = self.length, self.link, self.next, self.window
        state, n = 0, 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in following[state]:
                state = link[state]
                n = length[state]
            if w in following[state]:
                state, n = following[state][w], n + 1
            hit = 0
            if n >= window:
                hit, s = n, state
                while length[link[s]] >= window:
                    s = link[s]
                names |= self.inside.get(s, set())
            if self.whole:
                s, most = state, n
                while s > 0:
                    for k, own in self.whole.get(s, {}).items():
                        if k <= most:
                            hit = max(hit, k)
                            names |= own
                    s = link[s]
                    most = length[s]
            if hit:
                if runs and runs[-1][1] >= i - hit:
                    while len(runs) > 1 and runs[-2][1] >= i - hit:
                        runs.pop()
                    runs[-1][0], runs[-1][1] = min(runs[-1][0], i - hit), i
                else:
                    runs.append([i - hit, i])

    def match(self, found: list[bytes]) -> list[tuple[int, list[list[int]], set[str]]]:
        """For each text its number of words, the hit stretches of words and the items that occur."""
        split = [words(t) for t in found]
        ends = np.cumsum([0, *map(len, split)])
        ids = np.fromiter((i for ws in split for i in map(self.vocabulary.__getitem__, ws)), np.int64, ends[-1])
        out: list[tuple[int, list[list[int]], set[str]]] = [(len(ws), [], set()) for ws in split]
        if not len(ids) or not self.vocabulary:
            return out
        joined = np.zeros(len(ids) + 1, bool)  # whether a word continues the stretch of the word before
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[both] << 32 | ids[both + 1]
        if len(self.pairs):
            place = np.searchsorted(self.pairs, code)
            joined[both[self.pairs[np.minimum(place, len(self.pairs) - 1)] == code] + 1] = True
        joined[ends] = False
        starts = np.flatnonzero(~joined[:-1])
        stops = np.append(starts[1:], len(ids))
        good = (stops - starts >= self.least) & (ids[starts] > 0)
        starts, stops = starts[good], stops[good]
        for doc, a, b in zip((np.searchsorted(ends, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
            self.walk(ids[a:b].tolist(), a - int(ends[doc]), out[doc][1], out[doc][2])
        return out


def automata(benchmark: DataFrame, window: int, most_words: int) -> Iterator[Automaton]:
    """Automata of all items, each of at most about ``most_words`` words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    parts = max(1, -(-total // most_words))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        yield Automaton([(r[0], words(r[1].encode())) for r in own.collect()], window)


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _matching(docs: DataFrame, benchmark: DataFrame, text: str, name: str, *, window: int, most_words: int) -> DataFrame:
    """``docs`` with a struct ``name``: words (their number), runs (hit stretches [start, end) of words) and items (ids)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL("words long, runs array<array<long>>, items array<string>"))])
    kind = pa.struct([("words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
    own, out = docs.columns, docs
    at, width = own.index(text), len(own)
    for k, made in enumerate(automata(benchmark, window, most_words)):
        if k:
            out = stored(out)
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def f(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                found = shared.value.match(texts(b.column(at)))
                if k:
                    before = b.column(width).to_pylist()
                    found = [(n, _merged([*x["runs"], *runs]), names.union(x["items"])) for (n, runs, names), x in zip(found, before, strict=True)]
                rows = pa.array([{"words": n, "runs": runs, "items": sorted(names)} for n, runs, names in found], kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:width], rows], [*own, name])

        out = out.mapInArrow(f, schema)
    return out


def matched(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, most_words: int = 200_000) -> DataFrame:
    """``docs`` with bench_words (number of words), bench_runs (hit stretches [start, end) of words) and bench_items (ids).

    Columns of these names that ``docs`` has are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("bench_words", "bench_runs", "bench_items")]
    name = free_name(own, "found")
    out = _matching(docs.select(*own), benchmark, "text", name, window=window, most_words=most_words)
    return out.select(*own, *(F.col(f"{name}.{c}").alias(f"bench_{c}") for c in ("words", "runs", "items")))


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, percent: int = 5, most_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (at least ``percent`` of the words are hit) for each row."""
    n_hit = F.aggregate("bench_runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    out = matched(docs.select("doc_id", "text"), benchmark, window=window, most_words=most_words).select("doc_id", F.col("bench_words").alias("n_words"), n_hit.alias("n_hit"), "bench_items")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def without_spans(text: str, runs: list[list[int]]) -> str:
    """``text`` without the characters from the first to the last word of each stretch."""
    if not runs:
        return text
    spans, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def purged(made: Automaton, text: str | None, most_percent: int) -> tuple[bool, str | None]:
    """Whether a text stays, and what is left of it when its hit spans are taken out until none is hit."""
    n, runs, _ = made.match([(text or "").encode()])[0]
    if 100 * sum(b - a for a, b in runs) > most_percent * n:
        return False, None
    while runs:
        text = without_spans(text, runs)
        runs = made.match([text.encode()])[0][1]
    return True, text


def cleaned(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, most_percent: int = 50, most_words: int = 200_000) -> DataFrame:
    """``docs`` with every hit span taken out of its text; documents hit over more than ``most_percent`` of their words go.

    Taking spans out can bring words of a window together, so a text is matched again until none is hit; each turn takes words
    out, so it ends. With one automaton that happens in the worker, in one pass over the rows. Where the items need several,
    texts that were cut pass all of them again.
    """
    made = list(islice(automata(benchmark, window, most_words), 2))
    own = docs.columns
    at = own.index("text")
    if len(made) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(made[0])

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            found = shared.value.match(texts(b.column(at)))
            if not any(runs for _, runs, _ in found):
                return b
            rows = [purged(shared.value, t, most_percent) if runs else (True, t) for t, (_, runs, _) in zip(b.column(at).to_pylist(), found, strict=True)]
            new = pa.array([t for _, t in rows], b.column(at).type)
            return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], own).filter(pa.array([k for k, _ in rows]))

        return arrow_map(docs, f, docs.schema)

    name = free_name(docs.columns, "found")
    match = lambda df: stored(_matching(df, benchmark, "text", name, window=window, most_words=most_words))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        runs = pc.struct_field(b.column(len(own)), "runs").to_pylist()
        new = pa.array([t if t is None else without_spans(t, r) for t, r in zip(b.column(at).to_pylist(), runs, strict=True)], b.column(at).type)
        return pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(len(own))], own)

    n_hit, hit = F.aggregate(F.col(f"{name}.runs"), F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]), F.size(f"{name}.runs") > 0
    found = match(docs).where(100 * n_hit <= most_percent * F.col(f"{name}.words"))
    out = found.where(~hit).drop(name)
    left = found.where(hit)
    while not left.isEmpty():
        found = match(arrow_map(left, cut, docs.schema))
        out = out.unionByName(found.where(~hit).drop(name))
        left = found.where(hit)
    return out
