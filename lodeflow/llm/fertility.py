"""Quality rules from tokeniser fertility: how public vocabularies cut a text's words.

A word is a run without ASCII white space. Each distinct word is cut once for a worker (a bounded cache); a text's figures are
sums over its words, so whole texts count at any length. Characters per token of a SentencePiece vocabulary with byte fallback
and of a byte-level BPE, the share of byte tokens and the entropy of the tokens are held against bands by language, or by
script where the language has none.

Defined cases: a null or empty text has no words and fails the base rule; null languages use the script's bands; rows that
repeat are judged each for themselves; other columns pass through or are ignored.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeflow.llm.common import arrow_map, sole, texts

TOKENIZERS = "/opt/tokenizers"
SYMBOLS, SPACES, FOLLOWING = b"#*$%&|<>", b" \t\n\r\x0b\x0c", bytes(range(0x80, 0xC0))
CACHE, CACHE_BYTES = 1 << 17, 1 << 23


@dataclass(frozen=True)
class Band:
    """Limits of a text that is kept, whatever its length."""

    pieces: tuple[float, float] = (1.0, 12.0)
    byte_level: tuple[float, float] = (1.0, 12.0)
    byte_share: float = 0.2
    entropy: tuple[float, float] = (3.0, 14.0)

    def holds(self, per_piece: float, per_byte_level: float, byte_share: float, entropy: float) -> bool:
        inside = ((self.pieces, per_piece), (self.byte_level, per_byte_level), ((0.0, self.byte_share), byte_share), (self.entropy, entropy))
        return all(low <= x <= high for (low, high), x in inside)


BANDS: dict[str, Band] = {
    "en": Band((1.75, 6.0), (1.85, 6.5), 0.05, (4.5, 13.0)),
    "de": Band((1.75, 6.0), (1.85, 6.5), 0.05, (4.5, 13.0)),
    "fr": Band((1.60, 6.0), (1.62, 6.5), 0.05, (4.5, 13.0)),
    "es": Band((1.70, 6.0), (1.75, 6.5), 0.05, (4.5, 13.0)),
    "latin": Band((1.2, 8.0), (1.0, 8.0), 0.1, (4.0, 13.0)),
    "cyrillic": Band((0.9, 8.0), (0.5, 8.0), 0.2, (4.0, 13.0)),
    "han": Band((0.3, 4.0), (0.3, 4.0), 0.7, (3.5, 14.0)),
    "other": Band((0.2, 12.0), (0.2, 12.0), 1.0, (3.0, 14.0)),
}

_SCRIPTS = (("latin", 0x41, 0x24F), ("cyrillic", 0x400, 0x52F), ("han", 0x3040, 0x9FFF))


def script(text: str) -> str:
    """The script of most letters beyond the signs of ASCII."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = {name: int(((x >= a) & (x <= b)).sum()) for name, a, b in _SCRIPTS}
    n["other"] = int((x > 0x24F).sum()) - n["cyrillic"] - n["han"]
    return max(n, key=n.get) if any(n.values()) else "other"


class _Words:
    """Words cut once: their piece ids one after another, and for each word where they start, how many there are, how many of
    them are bytes and the number of byte-level tokens. Bounded by ``CACHE`` words and ``CACHE_BYTES`` of words and pieces."""

    def __init__(self, path: str) -> None:
        self.path, self.models = path, None
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = self.end = 0
        self.flat = np.empty(1 << 12, np.int32)
        self.figures = np.empty((4, 1 << 10), np.int32)

    def release(self) -> None:
        self.clear()
        self.models = None

    def _load(self) -> tuple:
        import sentencepiece
        import tiktoken

        pieces = sentencepiece.SentencePieceProcessor(model_file=f"{self.path}/piece_bpe_32k.model")
        of_bytes = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        with open(f"{self.path}/byte_bpe_multi_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return pieces, of_bytes, tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: set[bytes]) -> None:
        """Cut those of the words that aren't known; only the words of this call are sure to be known afterwards."""
        new = words - self.at.keys()
        if not new:
            return
        if self.at and (len(self.at) + len(new) > CACHE or self.bytes > CACHE_BYTES):
            self.clear()
            new = words
        if self.models is None:
            self.models = self._load()
        pieces, of_bytes, bpe = self.models
        plain = [w.decode("utf-8", "replace") for w in new]
        cut = pieces.encode(plain, num_threads=1)
        sizes = np.fromiter(map(len, cut), np.int32, len(cut))
        ends = np.cumsum(sizes)
        ids = np.fromiter(chain.from_iterable(cut), np.int32, int(ends[-1]))
        n_bytes = np.concatenate(([0], np.cumsum(of_bytes[ids])))
        level = np.fromiter((len(bpe.encode_ordinary(f" {t}")) for t in plain), np.int32, len(plain))
        n, k = len(self.at), len(new)
        if self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.end], np.empty(self.end + len(ids), np.int32)])
        if n + k > self.figures.shape[1]:
            self.figures = np.concatenate([self.figures[:, :n], np.empty((4, n + k), np.int32)], axis=1)
        self.flat[self.end : self.end + len(ids)] = ids
        self.figures[:, n : n + k] = self.end + ends - sizes, sizes, n_bytes[ends] - n_bytes[ends - sizes], level
        self.end += len(ids)
        self.at.update(zip(new, range(n, n + k), strict=True))
        self.bytes += sum(map(len, new)) + 4 * len(ids)


@lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


def repeated(ids: np.ndarray) -> int:
    """How many words stand in a window of three that is found twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] << 32 | ids[2:]
    x = np.sort(windows)
    twice = x[1:][x[1:] == x[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    cover = np.zeros(len(ids), bool)
    for i in range(3):
        cover[i : i + len(hit)] |= hit
    return int(cover.sum())


def duplicate_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_level_chars double, byte_share double, token_entropy double"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def measured(found: list[bytes], langs: list[str | None], path: str, bands: dict[str, Band]) -> list[tuple]:
    """A tuple of FIELDS for each text."""
    split = [t.split() for t in found]
    known = sole(_words(path))
    known.learn(set(chain.from_iterable(split)))
    place, flat = known.at.__getitem__, known.flat
    start, size, n_bytes, n_bpe = known.figures
    out = []
    for text, words, lang in zip(found, split, langs, strict=True):
        ids = np.fromiter(map(place, words), np.int64, len(words))
        chars, symbols = len(text.translate(None, SPACES + FOLLOWING)), len(text) - len(text.translate(None, SYMBOLS))
        repeat = repeated(ids)
        own, times = np.unique(ids, return_counts=True)
        length = size[own].astype(np.int64)
        n, bpe = int(np.dot(length, times)), int(np.dot(n_bpe[own], times))
        ends = np.cumsum(length)
        pieces = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[own] - ends + length, length)]
        each = np.bincount(pieces, np.repeat(times, length))
        each = each[each > 0]
        entropy = math.log2(n) - float(np.dot(each, np.log2(each))) / n if n else 0.0
        per, level, share = (chars / n, chars / bpe, float(np.dot(n_bytes[own], times)) / n) if n and bpe else (0.0, 0.0, 0.0)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        kept = not failed and (bands.get(lang or "") or bands[script(text.decode("utf-8", "replace"))]).holds(per, level, share, entropy)
        out.append((len(words), chars, symbols, duplicate_lines(text), repeat, failed, kept, n, per, level, share, entropy))
    return out


def judged(docs: DataFrame, *, tokenizers: str = TOKENIZERS, bands: dict[str, Band] | None = None) -> DataFrame:
    """doc_id and FIELDS for each row of (doc_id, text, lang)."""
    bands = bands or BANDS

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = measured(texts(b.column(1)), b.column(2).to_pylist(), tokenizers, bands)
        names = [x.split() for x in FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(names))], ["doc_id", *(x for x, _ in names)])

    docs = docs.select("doc_id", "text", "lang")
    return arrow_map(docs, f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def kept_documents(docs: DataFrame, *, tokenizers: str = TOKENIZERS, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    bands, (text, lang) = bands or BANDS, (docs.columns.index(c) for c in ("text", "lang"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = measured(texts(b.column(text)), b.column(lang).to_pylist(), tokenizers, bands)
        return b.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return arrow_map(docs, f, docs.schema)
