"""Token counts by a trie-shared dynamic programme over distinct pre-tokens.

A pre-token is a run without ASCII white space, with the mark of a word's start before it. Each worker inserts the distinct
ones into a trie. A node stands for a prefix, and holds the best unigram score of any cutting of it, with that cutting's number
of tokens; it is computed once, from the nodes above it, for all pre-tokens that share the prefix. Pre-tokens keep the count
of their last node, so a text's count is a sum of looked-up numbers and whole texts count at any length.

Pieces come from a public vocabulary. Its scores are ranks, so a piece's log-probability is taken from Zipf's law (rank +
``SHIFT``) over all pieces. A character without a piece falls back to its UTF-8 bytes, one token each, at the least score less
``PENALTY`` for the character. Of equal scores the one with the longer last piece wins.

The trie and the counts of a worker are bounded; when full they start anew. Pre-tokens beyond ``LONG`` characters aren't
inserted: the same recurrence runs over them with a window of the longest piece.

Defined cases: a null, empty or blank text has no pre-tokens and no tokens; bytes that aren't UTF-8 count as the replacement
character; rows that repeat count each for themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeflow.llm.common import arrow_map, texts

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
SHIFT, PENALTY = 2.7, 10.0
LONG, NODES, CACHE = 200, 1_000_000, 500_000


class Vocabulary:
    """Pieces with their log-probabilities."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
        rank = {i: k for k, i in enumerate(sorted(usual, key=lambda i: (-model.get_score(i), i)))}
        total = math.log(sum(1 / (k + SHIFT) for k in range(len(usual))))
        self.score = {model.id_to_piece(i): -math.log(k + SHIFT) - total for i, k in rank.items()}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - PENALTY


class Trie:
    """Pre-tokens with their numbers of tokens and of byte tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.edge: dict[int, int] = {}
        self.score, self.tokens, self.bytes = [0.0], [0], [0]
        self.terminal: dict[bytes, tuple[int, int]] = {}

    def insert(self, text: str) -> int:
        """The node of ``text``; nodes that are new get their forward scores."""
        edge, score, tokens, of_bytes = self.edge, self.score, self.tokens, self.bytes
        pieces, longest = self.vocabulary.score.get, self.vocabulary.longest
        node, above = 0, [0]
        for end, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            node = edge.get(key, 0)
            if not node:
                best = at = None
                for start in range(end - longest if end > longest else 0, end):
                    p = pieces(text[start:end])
                    if p is not None and (best is None or score[above[start]] + p > best):
                        at = above[start]
                        best = score[at] + p
                n, b = 1, 0
                if pieces(c) is None:
                    fallen = score[above[-1]] + self.vocabulary.unknown
                    if best is None or fallen > best:
                        best, at = fallen, above[-1]
                        n = b = len(c.encode("utf-8", "replace"))
                node = edge[key] = len(score)
                score.append(best)
                tokens.append(tokens[at] + n)
                of_bytes.append(of_bytes[at] + b)
            above.append(node)
        return node

    def add(self, word: bytes) -> tuple[int, int]:
        """The counts of a new pre-token."""
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > LONG:
            return forward(text, self.vocabulary)
        if len(self.score) > NODES or len(self.terminal) >= CACHE:
            self.clear()
        node = self.insert(text)
        found = self.terminal[word] = (self.tokens[node], self.bytes[node])
        return found

    def count(self, text: bytes) -> tuple[int, int, int]:
        """Pre-tokens, tokens and byte tokens of a text."""
        words, known = text.split(), self.terminal.get
        tokens = n_bytes = 0
        for w in words:
            n, b = known(w) or self.add(w)
            tokens += n
            n_bytes += b
        return len(words), tokens, n_bytes


def forward(text: str, vocabulary: Vocabulary) -> tuple[int, int]:
    """Tokens and byte tokens of one long pre-token; only the last scores are held."""
    longest, pieces = vocabulary.longest, vocabulary.score.get
    last = [(0.0, 0, 0)]
    for end, c in enumerate(text, 1):
        best = None
        for start in range(end - len(last), end):
            p = pieces(text[start:end])
            if p is not None:
                s, n, b = last[start - end]
                if best is None or s + p > best[0]:
                    best = (s + p, n + 1, b)
        if pieces(c) is None:
            s, n, b = last[-1]
            k = len(c.encode("utf-8", "replace"))
            if best is None or s + vocabulary.unknown > best[0]:
                best = (s + vocabulary.unknown, n + k, b + k)
        last.append(best)
        if len(last) > longest:
            del last[0]
    return last[-1][1:]


@lru_cache(1)
def _trie(path: str) -> Trie:
    return Trie(Vocabulary(path))


def token_counts(docs: DataFrame, *, tokenizers: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_words, n_tokens and n_byte_tokens for each row of (doc_id, text)."""
    path = f"{tokenizers}/{model}"

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        trie, found = _trie(path), texts(b.column(1))
        rows = [trie.count(t) for t in found]
        chars = [len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in found]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (chars, *([r[i] for r in rows] for i in range(3))))], ["doc_id", "n_chars", "n_words", "n_tokens", "n_byte_tokens"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, n_words long, n_tokens long, n_byte_tokens long")
