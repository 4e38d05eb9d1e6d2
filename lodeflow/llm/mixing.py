"""Mixing sources to target weights by the cube method.

A source's target over its size says how often each of its documents is taken: a whole number of times, and once more with the
fraction that remains. Those fractions are inclusion probabilities. The flight phase (fast form of Chauvet and Tille, 2006)
takes three units at a time and moves their probabilities along the null space of the two balancing equations, documents and
tokens, until one is 0 or 1; at most two units stay open. Rows equal in id, source and size are one group: moving their
probabilities among each other changes neither total, so at most one of them is open before the flight. Sources are dealt into
chunks of bounded size by a hash; what stays open in the chunks flies again in fewer chunks until each source has one. Long
units fly first, so those that stay open are the source's shortest. The landing rounds the last two at most; both totals then
differ from the wanted by those two units at most. A hot source has many chunks, so no task holds more than a chunk.

The sources' totals are collected up to ``most_sources``; more of them are dealt with as a table, by the same rule.

Defined cases: a null or wordless text has size 0 and is never taken; a null source is a source of its own, last in order;
targets are 0 where all texts are empty; rows that repeat share their group's copies, which differ by one at most; documents of
equal size are told apart by their ids; a very long text is one unit; an empty table gives no rows. ``mixed`` ignores other
columns, ``mixture`` passes them on, whatever their names, but for one called copies, which it replaces.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodeflow.llm.common import SPACE, free_name, stored
from lodeflow.operators.ordering import positions

CHUNK = 2000
NEAR = 1e-9


def n_words(text: Column) -> Column:
    """How many words a text has; none in null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Each source's target: ``share`` of all words by weight, none above ``most`` times its size, the excess dealt anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        now = {s: left * weight[s] / total for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return out | now
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are neither 0 nor 1; their sum and their sum weighed by size stay as they are."""
    p = p.astype(float).tolist()
    x = size.astype(float).tolist()
    draw = iter(random.random(len(p) + 1).tolist())
    active: list[int] = []
    for i in sorted(range(len(p)), key=lambda i: -x[i]):
        if not NEAR < p[i] < 1 - NEAR:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(active, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(active, u, strict=True) if v)
        step = up if next(draw) * (up + down) < down else -down
        for k, v in zip(active, u, strict=True):
            p[k] += step * v
            if not NEAR < p[k] < 1 - NEAR:
                p[k] = float(round(p[k]))
        active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """The few open probabilities rounded, so that the taken words come nearest to ``wanted``; of ties the likelier way."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    base, own = float(np.dot(p, size)) - float(np.dot(p[left], size[left])), p[left]
    ways = [np.array([(w >> j) & 1 for j in range(len(left))], float) for w in range(1 << len(left))]
    p[left] = min(ways, key=lambda w: (abs(base + float(np.dot(w, size[left])) - wanted), -float(np.prod(np.where(w > 0, own, 1 - own)))))
    return p


def _flown(units: DataFrame, seed: int, turn: int) -> DataFrame:
    """One turn of flights, each in its own chunk; where a source has one chunk it lands."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
        p, size = g["p"].to_numpy(float), g["size"].to_numpy(float)
        random = np.random.default_rng([seed, turn, int(g["chunk"].iloc[0]), len(g), int(size.sum())])
        new = flight(p, size, random)
        if g["chunks"].iloc[0] == 1:
            new = landing(new, size, float(np.dot(p, size)))
        return g.assign(p=new)[["doc_id", "source", "size", "n", "sure", "p", "chunks"]]

    chunk = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + turn)), F.col("chunks"))
    return units.withColumn("chunk", chunk).groupBy("source", "chunk").applyInPandas(f, units.schema)


def _many_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, size, groups, goal) of a table of sources, as ``targets`` deals them: a row of sums leaves each turn."""
    ranked = totals.select("source", "size", "groups", F.lit(0).alias("all"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("last"))
    ranked = positions(ranked, "all", ["last", "name"], as_name="rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    free = stored(ranked.select("source", "size", "groups", weight.alias("weight")))
    left, done = share * (free.agg(F.sum("size")).first()[0] or 0), None
    while True:
        whole = free.agg(F.sum("weight")).first()[0] or 1.0
        free = free.withColumn("goal", F.lit(left) * F.col("weight") / F.lit(whole))
        over = F.col("goal") > most * F.col("size")
        full = free.where(over).withColumn("goal", (most * F.col("size")).cast("double"))
        taken = full.agg(F.sum("goal")).first()[0]
        if taken is None:
            return (free if done is None else done.unionByName(free)).select("source", "size", "groups", "goal")
        left -= taken
        done = stored(full if done is None else done.unionByName(full))
        free = stored(free.where(~over).drop("goal"))


def _sources(groups: DataFrame, weights: tuple[float, ...], share: float, most: float, most_sources: int) -> tuple[DataFrame, int]:
    """(name, source_size, target, whole, each, chunks) of all sources, for a broadcast where they are few, and the most chunks."""
    spark = groups.sparkSession
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count_if(F.col("size") > 0).alias("groups"))
    few = totals.limit(most_sources + 1).collect()
    if len(few) <= most_sources:
        goal = targets({r["source"]: r["size"] for r in few}, weights=weights, share=share, most=most)
        totals = spark.createDataFrame([(r["source"], r["size"], r["groups"], goal[r["source"]]) for r in few], "source string, size long, groups long, goal double")
    else:
        totals = _many_targets(stored(totals), weights, share, most)
    each = F.when(F.col("size") > 0, F.col("goal") / F.col("size")).otherwise(0.0)
    whole = F.least(F.floor(each + NEAR), F.lit(math.floor(most))).cast("long")
    out = totals.select(
        F.col("source").alias("name"), F.col("size").alias("source_size"), F.col("goal").alias("target"), whole.alias("whole"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), each - whole)).alias("each"), F.greatest(F.lit(1), F.ceil(F.col("groups") / CHUNK)).cast("long").alias("chunks"),
    )
    if len(few) > most_sources:
        out = stored(out)
    chunks = out.agg(F.max("chunks")).first()[0] or 1
    return (F.broadcast(out) if len(few) <= most_sources else out), chunks


def grouped(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1, most_sources: int = 100_000) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, whole, more): n rows are equal in the first three columns; ``more`` of them
    are taken once more than ``whole`` times."""
    units = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"))
    groups = stored(units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sources, chunks = _sources(groups, weights, share, most, most_sources)
    named = groups.join(sources, groups["source"].eqNullSafe(sources["name"])).withColumn("p", F.when(F.col("size") > 0, F.col("n") * F.col("each")).otherwise(0.0))
    # among equal rows probabilities move freely: whole ones first, at most one row keeps a fraction
    named = named.withColumn("sure", F.floor(F.col("p") + NEAR)).withColumn("p", F.greatest(F.lit(0.0), F.col("p") - F.col("sure")))
    own = ("doc_id", "source", "size", "n", "sure", "p")
    done = named.where(F.col("p") <= NEAR).select(*own).withColumn("p", F.lit(0.0))
    left, turn = named.where(F.col("p") > NEAR).select(*own, "chunks"), 0
    settled = (F.col("p") == 0) | (F.col("p") == 1)
    while True:
        flown = stored(_flown(left, seed, turn))
        done = done.unionByName(flown.where(settled).select(*own))
        if chunks == 1:
            break
        left = flown.where(~settled).withColumn("chunks", F.ceil(2 * F.col("chunks") / CHUNK).cast("long"))
        chunks, turn = -(-2 * chunks // CHUNK), turn + 1
    out = done.join(sources, done["source"].eqNullSafe(sources["name"]))
    return out.select("doc_id", "source", "size", "n", "source_size", "target", "whole", (F.col("sure") + F.col("p").cast("long")).alias("more"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for each row of (doc_id, source, text); options are those of ``grouped``.

    ``weights`` repeat over the sources by code point, null last. The same rows give the same mix.
    """
    block = 4096  # rows of a large group are made in two steps, so that no array grows with the group
    out = grouped(docs, **options).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    out = out.withColumn("row", F.explode(F.sequence(F.col("block") * block + 1, F.least(F.col("n"), (F.col("block") + 1) * block))))
    copies = (F.col("whole") + F.when(F.col("row") <= F.col("more"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often (copies); of rows equal in id, source and size those first by their
    columns are taken once more."""
    own = [c for c in docs.columns if c.lower() != "copies"]
    key, place, picked = (free_name(own, c) for c in ("key", "place", "picked"))
    triple = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    groups = stored(grouped(docs.select("doc_id", "source", "text"), **options).where("whole > 0 or more > 0").select(
        F.struct("doc_id", "source", "size").alias(picked), F.col("n").alias(f"{picked}_n"), F.col("whole").alias(f"{picked}_whole"), F.col("more").alias(f"{picked}_more")))
    n, whole, more = (F.col(f"{picked}_{c}") for c in ("n", "whole", "more"))
    rows = docs.select(*own, triple.alias(key))
    rows = rows.join(groups, F.col(key).eqNullSafe(F.col(picked)))
    once = rows.where(n == 1).withColumn(place, F.lit(1).cast("long"))
    if not groups.where(n > 1).isEmpty():
        kinds = {f.name: f.dataType for f in docs.schema}
        tie = free_name([*own, key, place, picked], "tie")
        many = rows.where(n > 1).withColumn(tie, F.monotonically_increasing_id())  # rows equal in all columns may change places
        once = once.unionByName(positions(stored(many), key, [*(c for c in own if isinstance(kinds[c], AtomicType)), tie], as_name=place).drop(tie))
    out = once.withColumn("copies", (whole + F.when(F.col(place) <= more, 1).otherwise(0)).cast("long"))
    return out.where("copies > 0").select(*own, "copies")
