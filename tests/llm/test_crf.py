from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodeflow.llm import crf


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    e, start, step = rng.normal(size=(3, 5)), rng.normal(size=2), rng.normal(size=(2, 2))
    mask = np.array([[True] * 5, [True] * 2 + [False] * 3, [True] + [False] * 4])
    p, joint, z = crf.marginals(np.where(mask, e, 0), mask, start, step)
    steps = np.zeros((2, 2))
    for k, n in enumerate(mask.sum(axis=1)):
        ways = {y: np.exp(start[y[0]] + sum(e[k, t] * y[t] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=int(n))}
        total = sum(ways.values())
        assert np.isclose(z[k], np.log(total))
        for t in range(n):
            assert np.isclose(p[k, t], sum(v for y, v in ways.items() if y[t]) / total)
        for y, v in ways.items():
            for a, b in itertools.pairwise(y):
                steps[a, b] += v / total
    assert np.allclose(joint, steps)


def test_held_out_accuracy_and_cases(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = crf.trained(docs, labels)
    got = crf.scored(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    bad = [r.score for r in got if r.quality == 0]
    good = [r.score for r in got if r.quality == 1]
    auc = np.mean([[1.0 * (g > b) + 0.5 * (g == b) for b in bad] for g in good])
    print("accuracy", right, "auc", auc)
    assert right > 0.9 and auc > 0.9
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "x " * 200_000), (4, "\n" * 50_000), (None, "a b c."), (5, "the### and&&& to*** of$$$ in%%% thon### erhe***")], "doc_id long, text string").withColumn("score", F.lit("x"))
    rows = crf.scored(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and [r.predicted for r in rows if r.doc_id == 5] == [0]
    assert crf.scored(odd.limit(0), model).count() == 0
    lines = crf.labelled_lines(spark.createDataFrame([(1, "and the of to in.\n### &&& *** $$$"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.line, r.text) for r in lines] == [(1, 0, "and the of to in."), (1, 1, "### &&& *** $$$"), (2, 0, "")]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b\nc")], "doc_id long, text string")
    model = crf.trained(docs, spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, quality int"))
    assert [round(r.score, 6) for r in crf.scored(docs, model).collect()] == [0.5, 0.5]


def plain_figures(text):
    """The figures of a line, from their names."""
    seen, lines, out = set(), [], []
    for line in text.split("\n"):
        w = line.split()
        n, size = max(1, len(w)), max(1, len(line.encode()))
        ascii_letters = [c for c in line if c.isascii() and c.isalpha()]
        out.append([
            sum(c in "#*$%&|<>" for c in line) / n, sum(c.isupper() for c in ascii_letters) / max(1, len(ascii_letters)), sum(c in "!?" for c in line) / n, len(set(w)) / n,
            sum(len(x.encode()) for x in w) / n, sum(c in "0123456789" for c in line) / size, len(w), float(bool(w) and line in lines),
            len(set(w) & seen) / max(1, len(set(w))), sum(len(c.encode()) for c in line if not c.isascii()) / size, sum(a == b for a, b in zip(w, w[1:])) / n, line.count(".") / n,
            max((len(x.encode()) for x in w), default=0), sum(len(x.encode()) < 4 for x in w) / n,
        ])
        lines.append(line)
        seen |= set(w)
    return out


def test_scores_equal_an_enumeration_over_rebuilt_features(spark):
    rng = np.random.default_rng(4)
    w = lambda *n: rng.normal(0, 0.3, n)
    model = crf.Model(w(crf.WIDTH), w(crf.WIDTH), w(crf.WIDTH), w(2), w(2), w(2, 2))
    found = ["", "One line.", "The river ### is BIG!\nthe the 12 a.b é\n\nThe river ### is BIG!\nlast", " \n\n x"]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for r in crf.scored(df, model).collect():
        lines = found[r.doc_id].split("\n")
        at = [[k * crf.CLASSES + sum(v > limit for limit in crf.FIGURES[k][1]) for k, v in enumerate(row)] for row in plain_figures(found[r.doc_id])]
        e = [model.own[x].sum() + (model.before[at[i - 1]].sum() if i else model.edge[0]) + (model.after[at[i + 1]].sum() if i + 1 < len(at) else model.edge[1]) for i, x in enumerate(at)]
        ways = {y: np.exp(model.start[y[0]] + sum(e[t] * y[t] for t in range(len(e))) + sum(model.step[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(e))}
        good = [sum(v for y, v in ways.items() if y[t]) / sum(ways.values()) for t in range(len(e))]
        weight = [max(1, len(x.encode())) for x in lines]
        assert abs(r.score - sum(g * k for g, k in zip(good, weight, strict=True)) / sum(weight)) < 1e-9


def test_long_documents_take_part_in_the_fit(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 5000), (2, "### x\n" * 100), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    kept = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5}
    found = crf.chains(docs, labels, chain_lines=64, most_chains=8)
    sizes = {1: [64] * 8, 2: [64, 37], 3: [1]}
    assert [(i, len(x)) for i, _, x in found] == [(i, n) for i in sorted(kept) for n in sizes[i]]
