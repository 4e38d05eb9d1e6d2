"""Fertility rules, source mixing and benchmark decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np

from lodeflow.llm import automaton, fertility, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf="0.001"):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]


ODD = ["", None, "a", "x " * 60_000, "### &&& *** $$$ %%% <<< >>> |", "a b c a b c a b c", "same\nsame\n\n\nsame \nother", "漢字 текст é " * 40, "\x00 \x85 \xa0 b", "w" * 100_000]


def test_rules(spark):
    rows = documents(spark)[:120] + [(5000 + i, t, None, "s") for i, t in enumerate(ODD)] + [(5000, "", None, "s")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, kept boolean")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.judged(df).collect())
    want = []
    for i, t, _, _ in rows:
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want)
    kept = {r.doc_id for r in fertility.judged(df).where("kept").collect()}
    assert {r.doc_id for r in fertility.kept_documents(df).collect()} == kept and fertility.kept_documents(df).columns == df.columns
    assert fertility.judged(df.limit(0)).count() == 0


def test_clean_labelled_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = fertility.judged(docs).join(labels, "doc_id").where("not base_failed and quality = 1").selectExpr("avg(cast(kept as int)) as share").first()
    assert out.share > 0.99


def test_mixture(spark):
    rows = documents(spark, "0.01") + [(9000 + i, t, None, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, _, s in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mixed(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    total: Counter = Counter()
    for i, _, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(total.values()), {}, set(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2.0 * total[s] for s in over)
        free -= over
    taken: Counter = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 0.5 * max(size[i] for i, _, _, x in rows if x == s))
    again = mixing.mixed(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixture(df).columns == [*df.columns, "copies"]


def brute(rows, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(SMALL))
    windows = [(str(i), {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}) for i, w in ((i, cut(t)) for i, t in items) if w]
    out = []
    for i, t in rows:
        w, hit, names = cut(t), set(), set()
        for name, own in windows:
            for x in own:
                for k in range(len(w) - len(x) + 1):
                    if w[k] == x[0] and tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        names.add(name)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab") * rng.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 12, 13, 14, 30))))) for i in range(25)] + [(90, None), (91, "--"), (3, "a-B.a"), (7, "é É z")]
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        extra = rng.choice(items)[1] or ""
        rows.append((i, f"{text(rng.choice((0, 5, 40)))} Q, {extra.upper() if i % 3 else extra} {text(5)}"))
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(100, "")]
    df, bench = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bench_words int"), spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 60):  # one automaton, and several in turn
        assert sorted(map(tuple, automaton.report(df, bench, most_words=most).collect()), key=repr) == brute(rows, items)
    assert automaton.report(df.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in automaton.report(df, bench.limit(0)).collect())
    long_items = [(1, " ".join(f"w{k}" for k in range(20)))]
    docs = [(1, "keep this. " + long_items[0][1] + ", and that " + " ".join(f"x{k}" for k in range(40))), (2, "clean words"), (3, long_items[0][1]), (4, None)]
    out = {r.doc_id: r.text for r in automaton.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(long_items, "item_id long, text string")).collect()}
    assert out == {1: "keep this. , and that " + " ".join(f"x{k}" for k in range(40)), 2: "clean words", 4: None}


def test_cleaned_takes_out_deeply_nested_passages(spark):
    nested = "a b c"
    for _ in range(24):
        nested = f"a {nested} b c"
    docs = spark.createDataFrame([(1, f"keep {nested} this")], "doc_id long, text string")
    out = automaton.cleaned(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"), window=3)
    assert [r.text.split() for r in out.collect()] == [["keep", "this"]]


def test_fertility_figures_equal_plain_counts(spark):
    import base64
    import math

    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/piece_bpe_32k.model")
    with open(f"{fertility.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("plain", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    rows = documents(spark)[:150] + [(5000 + i, t, None, "s") for i, t in enumerate(ODD)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    by = {r[0]: r for r in rows}
    for r in fertility.judged(df).collect():
        words = WORD.findall(by[r.doc_id][1] or "")
        ids = [i for w in words for i in pieces.encode(w)]
        level = sum(len(bpe.encode_ordinary(f" {w}")) for w in words)
        n, chars = len(ids), sum(map(len, words))
        want = (n, chars / n, chars / level, sum(pieces.is_byte(i) for i in ids) / n, math.log2(n) - sum(k * math.log2(k) for k in Counter(ids).values()) / n) if n else (0, 0.0, 0.0, 0.0, 0.0)
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.n_tokens, r.chars_per_token, r.byte_level_chars, r.byte_share, r.token_entropy), want, strict=True))
        band = fertility.BANDS.get(by[r.doc_id][2] or "") or fertility.BANDS[fertility.script(by[r.doc_id][1] or "")]
        inside = band.pieces[0] <= want[1] <= band.pieces[1] and band.byte_level[0] <= want[2] <= band.byte_level[1] and want[3] <= band.byte_share and band.entropy[0] <= want[4] <= band.entropy[1]
        assert r.kept == (not r.base_failed and inside)


def test_flight_keeps_both_totals_and_the_probabilities():
    rng = np.random.default_rng(5)
    p, size = rng.random(60), rng.integers(1, 500, 60).astype(float)
    drawn = np.zeros(60)
    for seed in range(3000):
        out = mixing.flight(p, size, np.random.default_rng(seed))
        assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3 and ((out > 0) & (out < 1)).sum() <= 2
        drawn += out
    assert np.abs(drawn / 3000 - p).max() < 0.06


def test_document_totals_repeats_and_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), f"s{i % 4}") for i in range(3000)] + [(7, "a b c", "hot")] * 900 + [(8, f"a b {i}", "hot") for i in range(400)] + [(None, "x y", None)] * 5
    names = ["key", "place", "picked", "tie", "part", "own", "size", "n"]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], f"doc_id long, text string, source string, {', '.join(f'{n} int' for n in names)}").repartition(4)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        each = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - each * len(own)) < 2 and abs(sum(r.taken for r in own) - own[0].target) <= 2 * min(max(r.size for r in own), 60)
    mix = mixing.mixture(df)
    assert mix.columns == [*df.columns, "copies"]
    total = Counter()
    for r in mix.collect():
        total[r.source] += r.copies
        assert [r[n] for n in names] == list(range(8))
    assert total == Counter({s: n for s in {r.source for r in got} if (n := sum(r.copies for r in got if r.source == s))})
    many = sorted((tuple(r) for r in mixing.mixed(df, most_sources=2).collect()), key=repr)
    assert [(r[0], r[1], r[5]) for r in many] == [(r[0], r[1], r[5]) for r in sorted(map(tuple, got), key=repr)]
