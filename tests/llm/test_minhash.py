from __future__ import annotations

import random

import numpy as np

from lodeflow.llm import minhash


def sets_of(text: str | None, words: int) -> set[tuple]:
    w = [x.lower() for x in (text or "").encode().split()]
    return set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, int]:
    s = [(i, sets_of(t, words)) for i, t in rows]
    at = {i: i for i, _ in s}

    def top(i: int) -> int:
        while at[i] != i:
            i = at[i]
        return i

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                at[y] = x
    return {i: top(i) for i, _ in s}


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    base = [word() for _ in range(60)]
    rows: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c")]
    for i in range(150):  # one large group of near copies with ever more changes, in a common bucket
        t = list(base)
        for _ in range(i // 20):
            t[rng.randrange(60)] = word()
        rows.append((i, " ".join(t)))
    for i in range(150, 230):
        rows.append((i, " ".join(word() for _ in range(rng.choice((3, 10, 40, 200))))))
    rows += [(400 + i, rows[10 + i][1]) for i in range(10)] + [(500, rows[170][1].upper())]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, kept int").repartition(3)
    for words, percent, bands, band_rows in ((3, 85, 24, 6), (5, 80, 32, 5)):
        got = minhash.near_duplicates(df, words=words, percent=percent, bands=bands, rows=band_rows).collect()
        want = brute(rows, words, percent)
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(sets_of(t, words)) for i, t in rows}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (2, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, False), (2, 2, True)], key=repr)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        differ = sum(int(x ^ y).bit_count() for x, y in zip(minhash.parity(a).view(np.uint64), minhash.parity(b).view(np.uint64), strict=True))
        assert differ <= len(np.setxor1d(a, b))
