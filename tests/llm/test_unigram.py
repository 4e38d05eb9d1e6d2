from __future__ import annotations

import random

from lodeflow.llm import unigram

ODD = ["", None, " \t\n", "a", "x" * 1000, "Straße déjà 漢字 😀😀", "a b", "▁", "the theme then the", "q" * 199, "q" * 200, "z퟿" * 150]


def brute(word: str, v: unigram.Vocabulary) -> tuple[float, int]:
    text = unigram.MARK + word
    best = [(0.0, 0)]
    for e in range(1, len(text) + 1):
        ways = [(best[s][0] + v.score[text[s:e]], best[s][1] + 1) for s in range(e) if text[s:e] in v.score]
        if text[e - 1] not in v.score:
            ways.append((best[e - 1][0] + v.unknown, best[e - 1][1] + len(text[e - 1].encode())))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1]


def test_counts_equal_the_plain_programme(spark):
    v = unigram.Vocabulary(f"{unigram.TOKENIZERS}/{unigram.MODEL}")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(30).collect()]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(1002, ODD[2])]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, unigram.token_counts(df).collect()))
    known: dict[str, int] = {}
    want = []
    for i, t in docs:
        words = (t or "").encode().split()
        n = sum(known.setdefault(w, brute(w.decode(), v)[1]) for w in words)
        want.append((i, len(t or ""), len(words), n))
    assert [g[:4] for g in got] == sorted(want)
    assert unigram.token_counts(df.limit(0)).count() == 0


def test_library_finds_the_same_cuttings():
    from tokenizers import Tokenizer, models

    v = unigram.Vocabulary(f"{unigram.TOKENIZERS}/{unigram.MODEL}")
    other = Tokenizer(models.Unigram([("<unk>", 0.0), *v.score.items()], 0, False))
    trie = unigram.Trie(v)
    rng = random.Random(1)
    words = ["".join(rng.choices(["the", "ation", "er", "q", "Über", "x", "ing", "7", "-", "é"], k=rng.randint(1, 8))) for _ in range(500)]
    assert sum(trie.add(w.encode())[0] == len(other.encode(unigram.MARK + w).ids) for w in words) >= 495  # but for cuttings of equal score


def test_bounded_caches_change_nothing(monkeypatch):
    v = unigram.Vocabulary(f"{unigram.TOKENIZERS}/{unigram.MODEL}")
    words = [f"w{i % 70}ord{i % 11}" for i in range(300)]
    full = [unigram.Trie(v).count(w.encode()) for w in words]
    monkeypatch.setattr(unigram, "NODES", 20)
    small = unigram.Trie(v)
    assert [small.count(w.encode()) for w in words] == full
    monkeypatch.setattr(unigram, "LONG", 3)
    assert [small.count(w.encode()) for w in [f"x{w}" for w in words]] == [unigram.Trie(v).count(f"x{w}".encode()) for w in words]
