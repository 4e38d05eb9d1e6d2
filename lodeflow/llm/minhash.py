"""Circulant MinHash near-duplicates: candidates from bands, every link confirmed on full shingle sets.

One permutation scatters the shingles over a ring of 2**32 places; a second one, read from a start that moves one place for
each coordinate, gives all coordinates of a signature. Documents with equal shingle sets are one node from the start, so
copies never meet in a bucket. A bucket is settled by two stars, not by its pairs: all members are compared with two centres.
What is still apart then goes on: in small buckets all such members are compared, in large ones those that a prefix filter
with rare shingles first (and bounds on the overlap) leaves, which is exact.

Defined cases: a null or wordless text has no shingles, links with nothing and is its own component. Rows that repeat, even
with the same id, are rows of their own; a component's id is the smallest id in it, and nulls count only where no id is there
(then the id is null and no row is kept). A very long text is one row like any other: its shingles are hashed in place, its
signature is made in parts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lodeflow.llm.common import arrow_map, sole, stored, texts

CACHE = 1 << 16


class _Hashes(dict):
    """64-bit hashes of words, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    release = dict.clear


_hashes = _Hashes()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(found: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a shorter text is one shingle of its own kind."""
    split, known = [t.lower().split() for t in found], sole(_hashes)
    ends = np.cumsum([0, *map(len, split)])
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, ends[-1])
    full = _mixed(h, words) if len(h) >= words else None
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if e - s >= words:
            x = np.sort(full[s : e - words + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(_mixed(h[s:e], e - s) if e > s else h[:0])
    return out


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words."""
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation of (first permutation - k)."""
    place = (_mix64(items ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 256):
        x = place[at : at + 256, None] - shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """For each signature a 64-bit key for each band, with the band's number in it."""
    bands = signatures.reshape(len(signatures), signatures.shape[1] // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).view(np.int64)))


PARITY = ("q0", "q1", "q2", "q3")


def parity(items: np.ndarray) -> np.ndarray:
    """256 bits: whether an odd number of items falls into each of as many buckets.

    Where two sets' bits differ, at least one item is in one of them only.
    """
    return np.packbits((np.bincount((items & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _node(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signed(docs: DataFrame, *, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, n_shingles, keys): node is a 128-bit digest of the whole shingle set."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts(b.column(1)), words)
        made = iter(band_keys(np.array([signature(s, bands * rows) for s in sets if len(s)], np.uint32).reshape(-1, bands * rows), rows))
        keys = [next(made) if len(s) else np.empty(0, np.int64) for s in sets]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_node, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _ragged(keys)], ["doc_id", "node", "n_shingles", "keys"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), f, "doc_id long, node binary, n_shingles long, keys array<long>")


def shingle_sets(docs: DataFrame, *, words: int) -> DataFrame:
    """(node, items, q0 .. q3): the sets themselves and their parity bits."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(texts(b.column(0)), words)
        bits = np.array(list(map(parity, sets)), np.int64).reshape(-1, len(PARITY))
        return pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.binary()), _ragged([s.view(np.int64) for s in sets]), *(pa.array(bits[:, k]) for k in range(len(PARITY)))], ["node", "items", *PARITY])

    return arrow_map(docs.select("text"), f, f"node binary, items array<long>, {', '.join(f'{q} long' for q in PARITY)}")


def with_nodes(docs: DataFrame, *, words: int, name: str = "node") -> DataFrame:
    """``docs`` with ``name``, the digest that near_duplicates gives its rows."""
    at = docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(map(_node, shingles(texts(b.column(at)), words)), pa.binary())], [*b.schema.names, name])

    return arrow_map(docs, f, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    n = F.size(F.array_intersect("a_items", "b_items"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * n >= percent * (F.size("a_items") + F.size("b_items") - n)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large and small stars (Kiveris and others, 2014).

    The turns end when the edges stay the same, which they do: each turn only lowers the neighbours of the nodes. What is
    aggregated is stored before its join: between plain tables Spark splits the rows of a node with many neighbours.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        e = stored(
            large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, small: int = 16) -> DataFrame:
    """(doc_id, node, n_shingles, component, component_id, kept) for each row of (doc_id, text); component is its least node.

    Linked are rows with 100 * |intersection| >= percent * |union|, whatever the size of a group. A pair at the limit itself
    is missed by all bands with a chance of (1 - (percent / 100) ** rows) ** bands, 3e-6 with the defaults.
    """
    docs = docs.select("doc_id", "text")
    sig = stored(signed(docs, words=words, bands=bands, rows=rows))
    classes = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    cells = classes.select("node", "n", F.explode("keys").alias("key"))
    met = cells.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    met = stored(met.where("size > 1"))  # a table of its own, like split below, so that Spark can split the members of a frequent key
    cells = stored(cells.join(met, "key").select("key", "size", "first", "last", "node", "n"))
    known = stored(cells.select("node").distinct())
    wanted = classes.join(known, "node", "left_semi").select(F.col("rep").alias("wanted")).distinct()
    sets = shingle_sets(docs.join(wanted, docs["doc_id"].cast("long").eqNullSafe(wanted["wanted"]), "left_semi"), words=words)
    sets = stored(sets.groupBy("node").agg(F.first("items").alias("items"), *(F.first(q).alias(q) for q in PARITY)).join(known, "node", "left_semi"))

    stars = cells.select("node", F.explode(F.array_distinct(F.array("first", "last"))).alias("centre")).where("node <> centre")
    stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = stored(confirmed(stars, sets, percent))
    at = components(links)
    cells = cells.join(at, "node", "left").select("key", "size", "node", "n", F.coalesce("label", "node").alias("label"))
    split = stored(cells.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key"))
    cells = stored(cells.join(split, "key", "left_semi"))
    few = cells.where(F.col("size") <= small).withColumns({"most": F.col("n"), "left": F.col("n")})
    rest = _apart(few.join(sets.select("node", *PARITY), "node"), percent)
    rest = rest.unionByName(_rare_first(cells.where(F.col("size") > small).select("node", "label", "n").distinct(), sets, percent))
    rest = stored(rest.distinct().join(stars, ["a", "b"], "left_anti"))
    at = components(at.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(confirmed(rest, sets, percent)))

    ids = stored(classes.select("node", "rep").join(at, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = stored(ids.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes"))
    ids = ids.join(least, "label", "left").select("node", F.col("label").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    out = sig.select("doc_id", "node", "n_shingles").join(ids, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "node", "n_shingles", "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Members of a key that one task compares at most with those outside its largest component; a key with more is dealt into salts.
CROWD = 1024


def _apart(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with the same key in different components whose overlap can be large enough.

    size: how many nodes have the key; most: how many items the node can share with another; left: how many of them from this
    key on. Sets with more differing parity bits than the similarity lets items differ are left out, too. Members of a key's
    largest component aren't joined with each other. The members of a key with many nodes are dealt by salts, and only those
    outside the largest component are repeated for each salt.
    """
    salts = F.ceil(F.col("size") / CROWD).cast("int")
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    top = cells.groupBy("key", "label").agg(F.count("*").alias("c"), F.first(salts).alias("salts"))
    top = top.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("labels"), F.max("salts").alias("salts")).where("labels > 1")
    top = top.select("key", "top", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    a = cells.join(top, ["key", "salt"]).where("label <> top")
    a = a.select("key", "top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("x"), *(F.col(c).alias(f"{c}_a") for c in ("label", "n", "most", "left", *PARITY)))
    b = cells.select(F.col("key").alias("key_b"), F.col("salt").alias("salt_b"), F.col("node").alias("y"), *(F.col(c).alias(f"{c}_b") for c in ("label", "n", "most", "left", *PARITY)))
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{q}_a").bitwiseXOR(F.col(f"{q}_b"))) for q in PARITY))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    shared = F.least("most_a", "most_b", "left_a", "left_b")
    met = (F.col("key") == F.col("key_b")) & (F.col("salt") == F.col("salt_b")) & (F.col("label_a") != F.col("label_b")) & ((F.col("x") < F.col("y")) | (F.col("label_b") == F.col("top")))
    return a.join(b, met & near & (100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _rare_first(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that share a shingle among their rarest ones; no pair of similar sets is left out.

    Sets that reach the similarity share one of the first n - ceil(percent * n / 100) + 1 shingles of any common order, and the
    first that they share leaves room for the overlap they need. Shingles of one node only come first, and stay out of the join.
    """
    own = nodes.join(sets.select("node", "items"), "node").select("node", "label", "n", F.explode("items").alias("item"))
    often = own.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = own.join(often, "item").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("x"))
    ranked = ranked.withColumn("most", F.size("x").cast("long")).where(100 * F.col("most") >= percent * F.col("n"))
    keep = F.expr(f"cast(n - ceil({percent} * n / 100d) + 1 - (n - most) as int)")
    front = ranked.select("node", "label", "n", "most", F.posexplode(F.slice(F.col("x"), F.lit(1), keep)).alias("at", "y"))
    front = front.select("node", "label", "n", "most", (F.col("most") - F.col("at")).alias("left"), F.col("y.item").alias("key"), F.col("y.df").alias("size"))
    return _apart(front.join(sets.select("node", *PARITY), "node"), percent)
