"""Queries on rows that the smaller tables lack, against their SQL."""

from __future__ import annotations

import itertools
import random

import duckdb

from lodeflow.functions import tables
from lodeflow.functions.shared import shared_dir
from lodeflow.operators import aggregates, similarity
from lodeflow.plans import catalogue


def both(spark, name, table, df):
    """The rows of a query and those of its SQL over one table."""
    folder = shared_dir(spark).removeprefix("file://")
    df.coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    own = catalogue.QUERIES[name](spark, f"file://{folder}").select(*names)
    return sorted((tuple(r) for r in own.collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_fixed_width_keys(spark):
    items = [(7, 1, 1), (999999, 2, 3), (9999991, 3, 4), (1234567, -4, -5), (None, 5, 6), (8, None, 7), (9, 8, None)]
    df = spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_partkey long").selectExpr("*", "1 AS l_linenumber", "3.0D AS l_quantity", "timestamp'1995-02-03' AS l_shipdate")
    got, want = both(spark, "fixed_width_parse", "lineitem", df)
    assert got == want and len(got) == 7


def test_average_jaccard_moves_no_blocks(spark):
    sets = spark.range(700).selectExpr("id", "transform(sequence(0, 9), j -> IF(j = 0, 0, id div 7 + 100 * (j % 4) + 1000 * (id % 2) * (j div 8))) AS items").selectExpr("id", "array_distinct(items) AS items")
    found = similarity.average_jaccard(sets.unionByName(spark.createDataFrame([(1000, [-1]), (1001, [])], sets.schema)), block=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "a_items" not in plan  # whole sets were sent to each pair of blocks
    own = {r.id: set(r["items"]) for r in sets.collect()} | {1000: {-1}, 1001: set()}
    each = [len(own[a] & own[b]) / (len(own[a] | own[b]) or 1) for a, b in itertools.combinations(own, 2)]
    average, pairs = found.first()
    assert pairs == len(each) and abs(average - sum(each) / pairs) < 1e-12


def test_lsh_pairs_compares_few_sets(spark, monkeypatch):
    draw = random.Random(5)
    own = {i: {f"w{w}" for w in draw.sample(range(150), 60)} for i in range(200)} | {1000 + i: {f"x{j}" for j in range(i, i + 30)} for i in range(0, 40, 5)}
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id long, items array<string>")
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in itertools.combinations(own, 2)}
    compared = []
    verified = similarity._verified
    monkeypatch.setattr(similarity, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    found = {(r.a, r.b): r.jaccard for r in similarity.lsh_pairs(sets, n_hashes=180, n_bands=60).collect()}
    assert found == {p: j for p, j in want.items() if j >= 0.5} != {}
    assert compared[0] < 0.25 * len(want)  # most pairs at 0.25 share a band


def test_neighbours_move_pairs_once(spark):
    draw = random.Random(3)
    texts = ["\n".join(" ".join(draw.choice("abcdefg") * 2 for _ in range(draw.randint(0, 9))) for _ in range(4)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = aggregates.neighbours(docs, "text", least=5)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 4  # two steps for the pairs, two for those found often
    got, want = both(spark, "neighbors", "documents", docs)
    assert got == want and len(got) > 20


def test_spread_by_bytes(spark, monkeypatch):
    docs = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text").coalesce(1)
    monkeypatch.setattr(tables, "TASK_BYTES", 10_000)
    assert tables.spread(docs, "text").rdd.getNumPartitions() == 11 and tables.spread(docs).rdd.getNumPartitions() == 4


def test_similar_pairs_compare_few_sets(spark, monkeypatch):
    draw = random.Random(7)
    own = {i: set(draw.sample(range(60), draw.randint(1, 6))) for i in range(300)} | {400 + i: set(range(100 + i, 500 + 2 * i)) for i in range(6)}
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "id long, items array<long>")
    firsts = {frozenset(s): i for i, s in reversed(own.items())}
    reps = {i: own[i] for i in firsts.values()}
    want = {(min(a, b), max(a, b)): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in itertools.combinations(reps, 2)}
    compared = []
    verified = similarity._verified
    monkeypatch.setattr(similarity, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    for least in (0.3, 0.5, 1.0):
        found = {(r.a, r.b): r.jaccard for r in similarity.similar_pairs(sets, least=least).collect()}
        assert found == {p: j for p, j in want.items() if j >= least}
        assert compared.pop() <= 1.5 * len(found)
