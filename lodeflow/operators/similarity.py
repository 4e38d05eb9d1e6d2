"""Set similarity: MinHash signatures, banding, exact joins and the mathematics of their parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeflow.functions import exprs
from lodeflow.functions.shared import stored

PRIME = (1 << 31) - 1
#: Multiplier of the bucket hash, a fixed value.
BUCKET_PRIME = 433494437


def coefficients(n: int, seed: int = 1) -> list[tuple[int, int]]:
    """n pairs (a, b) within [1, PRIME), from a linear congruential generator."""

    def draw() -> Iterator[int]:
        x = seed
        while True:
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            yield (x >> 33) % (PRIME - 1) + 1

    d = draw()
    return [(next(d), next(d)) for _ in range(n)]


def signature(hashes: Column, coefs: list[tuple[int, int]]) -> Column:
    """MinHash of an array of numbers below 2**32, inside the row: the least of (a * h + b) mod PRIME for each pair; PRIME if empty."""

    def least(a: int, b: int) -> Column:
        return F.coalesce(F.array_min(F.transform(hashes, lambda h: F.pmod(h * a + b, F.lit(PRIME)))), F.lit(PRIME)).cast("long")

    return F.array(*(least(a, b) for a, b in coefs))


def signed(items: Column, n_hashes: int) -> Column:
    """The signature of an array of strings or numbers; the items are hashed once."""
    hashes = F.transform(items, lambda v: exprs.md5_32(v.cast("string")))
    return F.transform(F.array(hashes), lambda h: signature(h, coefficients(n_hashes)))[0]


def banded(items: Column, n_hashes: int, n_bands: int) -> Column:
    """The band keys of an array."""
    return F.transform(F.array(signed(items, n_hashes)), lambda s: bands(s, n_bands, n_hashes // n_bands))[0]


def _same_size(a: Column, b: Column, value: Column, what: str) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit(f"{what} of different sizes"))).otherwise(value)


def true_places(bits: Column) -> Column:
    """A vector of booleans as the set of its true places, from 0; null counts as false."""
    return F.filter(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: F.coalesce(F.get(bits, i), F.lit(False)))


def jaccard_bits(a: Column, b: Column) -> Column:
    """Jaccard index of two vectors of booleans; an error where their sizes differ."""
    return _same_size(a, b, exprs.jaccard(true_places(a), true_places(b)), "vectors")


def buckets_of_bits(bits: Column, stages: int, n_buckets: int) -> Column:
    """A bucket for each stage of a vector of booleans: the sum of (place + 1) * BUCKET_PRIME over its true places, modulo PRIME."""
    rows = F.floor(F.size(bits) / stages)
    stage = lambda i: F.least(F.floor(i / rows), F.lit(stages - 1))
    add = lambda acc, i: F.pmod(acc + (i + 1) * F.lit(BUCKET_PRIME).cast("long"), F.lit(PRIME).cast("long"))
    own = lambda k: F.filter(true_places(bits), lambda i: stage(i) == k)
    return F.array(*(F.pmod(F.aggregate(own(k), F.lit(0).cast("long"), add), F.lit(n_buckets)) for k in range(stages)))


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures; an error where their sizes differ."""
    return _same_size(a, b, F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a), "signatures")


def bands(sig: Column, n_bands: int, rows: int) -> Column:
    """A key for each band, with the band's number in it."""
    return F.array(*(F.concat_ws(",", F.lit(str(k)), F.transform(F.slice(sig, k * rows + 1, rows), lambda v: v.cast("string"))) for k in range(n_bands)))


def buckets(sig: Column, stages: int, rows: int, n_buckets: int) -> Column:
    """A bucket for each stage: a rolling hash of the stage's places; the last stage takes what remains."""
    size = F.size(sig)
    part = lambda k: F.slice(sig, F.lit(k * rows + 1), F.greatest(F.lit(0), size - k * rows) if k == stages - 1 else F.lit(rows))
    return F.array(*(F.aggregate(part(k), F.lit(0).cast("long"), lambda acc, v: (acc + v * BUCKET_PRIME) % n_buckets) for k in range(stages)))


def word_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, items): distinct words of each row, sorted."""
    return docs.select(F.col(key).alias("id"), F.sort_array(F.array_distinct(exprs.letters(F.col(text)))).alias("items"))


def classes(sets: DataFrame) -> DataFrame:
    """(id, items): one row, that of the least id, for all rows with equal sets; empty sets go."""
    digest = F.sha2(F.array_join(F.transform("items", lambda v: v.cast("string")), "\n"), 256)
    return sets.where(F.size("items") > 0).groupBy(digest.alias("_d")).agg(F.min("id").alias("id"), F.first("items").alias("items")).select("id", "items")


def signatures(sets: DataFrame, n_hashes: int, *keep: str) -> DataFrame:
    """(id, sig), after ``keep``: the signatures of ``signed`` by one aggregation over the items, whose partial results leave a task once an id.

    For many hashes: the minima are compiled, while ``signed`` works through lambdas. Ids don't repeat; empty sets have no row.
    """
    own = sets.select("id", *keep, F.explode("items").alias("item")).select("id", *keep, exprs.md5_32(F.col("item").cast("string")).alias("h"))
    least = (F.min(F.pmod(F.col("h") * a + b, F.lit(PRIME))).alias(f"s{k}") for k, (a, b) in enumerate(coefficients(n_hashes)))
    return own.groupBy("id", *keep).agg(*least).select("id", *keep, F.array(*(f"s{k}" for k in range(n_hashes))).alias("sig"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole sets are similar enough; strings are compared by 64-bit hashes, which are less to move."""
    if isinstance(sets.schema["items"].dataType.elementType, StringType):
        sets = sets.select("id", F.transform("items", lambda v: F.xxhash64(v)).alias("items"))
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("a_items"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("b_items"))
    out = pairs.join(a, "a").join(b, "b").select("a", "b", exprs.jaccard(F.col("a_items"), F.col("b_items")).alias("jaccard"))
    return out.where(F.col("jaccard") >= least)


def _near(least: float) -> Column:
    """Whether the sizes a_n and b_n of two sets let them be similar enough."""
    return F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n") - 1e-9


def _sketch(sig: Column, n: int) -> list[Column]:
    """The lowest four bits of n signature places, 16 places to a bigint."""
    spot = lambda k: F.shiftleft(F.get(sig, F.lit(k)).bitwiseAND(15), 4 * (k % 16))
    return [reduce(Column.bitwiseOR, map(spot, range(at, min(at + 16, n)))) for at in range(0, n, 16)]


def _unequal(a: Column, b: Column) -> Column:
    """How many of the 16 places of two sketch words differ."""
    two = (lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2)))(a.bitwiseXOR(b))
    return F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 1)).bitwiseAND(0x1111111111111111))


def most_unequal(least: float, n: int) -> int:
    """How many of n sketch places may differ: five standard deviations above the mean for sets of the similarity ``least``."""
    p = 15 / 16 * (1 - least)
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def lsh_pairs(sets: DataFrame, *, n_hashes: int | None = None, n_bands: int = 10, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard): pairs of classes of equal sets that are similar enough, a < b; all of them, by ``similar_pairs``.

    With n_hashes only pairs that share a band are found, and some near ``least`` are missed. The exchange holds a key for each
    band with four bits of each place of the signature: pairs whose sizes or places differ too much end in the join (a pair at
    ``least`` by its places with a chance of 3e-7), so that few sets are compared that aren't similar. Copies are one row from
    the start. Ids don't repeat.
    """
    if n_hashes is None:
        return similar_pairs(sets, least=least)
    reps = stored(classes(sets))
    rows = n_hashes // n_bands
    key = lambda k: F.xxhash64(F.lit(k), *(F.get("sig", F.lit(k * rows + r)) for r in range(rows)))
    words = [w.alias(f"w{i}") for i, w in enumerate(_sketch(F.col("sig"), n_hashes))]
    keys = signatures(reps.withColumn("n", F.size("items")), n_hashes, "n")
    keys = keys.select("id", "n", *words, F.array(*map(key, range(n_bands))).alias("keys"))
    keys = keys.select("*", F.explode("keys").alias("key")).drop("keys")
    a, b = (keys.select(*(F.col(c).alias(f"{s}_{c}") for c in keys.columns if c != "key"), "key") for s in "ab")
    close = reduce(Column.__add__, (_unequal(F.col(f"a_w{i}"), F.col(f"b_w{i}")) for i in range(len(words)))) <= most_unequal(least, n_hashes)
    met = a.join(b, "key").where((F.col("a_id") < F.col("b_id")) & _near(least) & close).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return _verified(met.distinct(), reps, least)


def _parities(item: Column, words: int = 4) -> list[Column]:
    """Aggregates: the items of a set thrown into 64 bits a word by their hashes, each bit the parity of its items."""
    h = F.xxhash64(item)
    spot = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return [F.bit_xor(F.when(F.shiftright(h, 6).bitwiseAND(words - 1) == k, spot).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(words)]


def similar_pairs(sets: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard): all pairs of classes of equal sets with a Jaccard index of ``least`` or more, exactly, a < b.

    Two such sets share one of the first n - ceil(least * n) + 1 items of each in any common order (the prefix filter), and
    their sizes are near; items in few sets come first, so the join's keys are rare. Each odd bit of two sets' parities shows
    an item that only one has, so pairs with too many end in the join; none is lost by that.
    """
    reps = stored(classes(sets))
    own = reps.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = own.groupBy("item").agg(F.count("*").alias("df"))
    ranked = own.join(often, "item").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("x"), *_parities(F.col("item")))
    keep = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    words = [c for c in ranked.columns if c.startswith("w")]
    front = ranked.select("id", "n", *words, F.explode(F.slice(F.col("x"), F.lit(1), keep)).alias("e")).where("e.df > 1").select("id", "n", *words, F.col("e.item").alias("item"))
    a, b = (front.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", *words)), "item") for s in "ab")
    odd = reduce(Column.__add__, (F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words))
    close = odd <= (F.col("a_n") + F.col("b_n")) * ((1 - least) / (1 + least)) + 1e-9
    met = a.join(b, "item").where((F.col("a_id") < F.col("b_id")) & _near(least) & close).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return _verified(met.distinct(), reps, least)


def block_pairs(sets: DataFrame, blocks: int) -> DataFrame:
    """Every pair of rows (a_id, a_items, b_id, b_items), a_id < b_id, met once in one of the pairs of blocks.

    For small tables or measured samples: the work is quadratic, but a task holds one block at a time.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(blocks))
    left = sets.select(F.col("id").alias("a_id"), F.col("items").alias("a_items"), at.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    right = sets.select(F.col("id").alias("b_id"), F.col("items").alias("b_items"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), at.alias("j"))
    left = left.repartition(min(blocks * blocks, 10_000), "i", "j")  # the rows are few, the work for each is not
    return left.join(right, ["i", "j"]).where("a_id < b_id").drop("i", "j")


def average_jaccard(sets: DataFrame, *, block: int = 128) -> DataFrame:
    """(average, pairs): the mean Jaccard index over all pairs of rows; null without pairs. Ids don't repeat.

    Pairs without a common item add nothing to the sum, so only the others are made, from the lists of each item's sets: a list
    goes once to each block of sets (ranges of ids) that it meets, and a block counts its sets' common items with all later
    ones. The work grows with the pairs that share an item; only sums leave the blocks. Sizes travel in the sets' numbers.
    """
    own = stored(sets.where("id is not null").select("id", "items"))
    n = own.count()
    blocks = min(max(1, -(-n // block)), 1 << 14)
    ranged = own.repartitionByRange(blocks, "id").sortWithinPartitions("id")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 17) - 1)  # within the block, which has fewer by far
    number = F.shiftleft(F.spark_partition_id().cast("long"), 49) + F.shiftleft(place, 32) + F.size("items")
    size, block_of = (lambda c: c.bitwiseAND((1 << 32) - 1)), (lambda c: F.shiftright(c, 49))
    items = ranged.select(number.alias("x"), "items").select("x", F.explode("items").alias("item"))
    lists = items.groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("l")).where(F.size("l") > 1)
    lists = lists.select("l", F.transform("l", block_of).alias("at")).select("l", "at", F.explode(F.array_distinct("at")).alias("p"))
    first = F.array_position("at", F.col("p")).cast("int")
    lists = lists.select("p", F.slice("l", first, F.size("l")).alias("l"), F.size(F.filter("at", lambda q: q == F.col("p"))).alias("k")).where(F.size("l") > 1)
    left = lists.repartition(blocks, "p").select("p", "l", F.posexplode(F.slice("l", F.lit(1), F.col("k"))).alias("i", "a"))
    pairs = left.select("p", "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).groupBy("p", "a", "b").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum(F.col("n") / (size(F.col("a")) + size(F.col("b")) - F.col("n"))).alias("total"))
    every = n * (n - 1) // 2
    return total.select((F.coalesce("total", F.lit(0.0)) / F.lit(every or None).cast("long")).alias("average"), F.lit(every).cast("long").alias("pairs"))


def bucket_counts(sets: DataFrame, *, n_hashes: int = 20, stages: int = 4, n_buckets: int = 10) -> DataFrame:
    """(stage, bucket, n): how the sets spread over the buckets of each stage."""
    at = F.transform(F.array(signed(F.col("items"), n_hashes)), lambda s: buckets(s, stages, n_hashes // stages, n_buckets))[0]
    found = sets.where(F.size("items") > 0).select(F.posexplode(at).alias("stage", "bucket"))
    return found.groupBy("stage", "bucket").agg(F.count("*").alias("n"))


def random_sets(spark: SparkSession, n: int, dimensions: int) -> DataFrame:
    """(id, items): an experiment's n sets in families of ten: a quarter of the dimensions, with ever more of them flipped."""
    draw = lambda *x: exprs.md5_32(F.concat_ws(":", *x)) / float(1 << 32)
    s = lambda c: c.cast("string")
    family = F.floor(F.col("id") / 10)
    there = lambda j: (draw(F.lit("b"), s(family), s(j)) < 0.25) != (draw(F.lit("f"), s(F.col("id")), s(j)) < 0.02 * F.pmod(F.col("id"), F.lit(10)))
    return spark.range(n).select("id", F.filter(F.sequence(F.lit(0), F.lit(dimensions - 1)), there).alias("items"))


def collision_curve(sets: DataFrame, *, stages: Sequence[int] = range(1, 11), n_buckets: int = 10, block: int = 64) -> DataFrame:
    """(stages, decile, pairs, collided): for each number of stages, by tenths of similarity, how many pairs there are and how
    many share a stage's bucket.

    ``lsh_size`` of the stages is the length of their signatures; all are beginnings of one. A pair is met once for all numbers.
    """

    def placed(sig: Column, n: int) -> Column:
        size = lsh_size(n)
        return F.transform(buckets(F.slice(sig, 1, size), n, size // n, n_buckets), lambda v, k: k * n_buckets + v)

    placings = F.transform(F.array(signed(F.col("items"), max(map(lsh_size, stages)))), lambda sig: F.array(*(placed(sig, n) for n in stages)))[0]
    pairs = block_pairs(sets.select("id", F.struct("items", placings.alias("at")).alias("items")), max(1, -(-sets.count() // block)))
    decile = F.floor(exprs.jaccard(F.col("a_items.items"), F.col("b_items.items")) * 10 + 1e-9).cast("int").alias("decile")
    met = [F.arrays_overlap(F.col("a_items.at")[i], F.col("b_items.at")[i]) for i in range(len(stages))]
    counted = pairs.groupBy(decile).agg(F.count("*").alias("pairs"), F.array(*map(F.count_if, met)).alias("met"))
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("stages"), F.get("met", F.lit(i)).alias("collided")) for i, n in enumerate(stages))))
    return counted.select("decile", "pairs", rows).select("stages", "decile", "pairs", "collided")


def s_curve_grid(spark: SparkSession, *, n_bands: tuple[int, int] = (30, 50), rows: tuple[int, int] = (3, 7), high: tuple[float, float] = (0.5, 0.8), low: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """(bands, rows, p_high, p_low): settings whose chance of a common band is at least / below what is wanted."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(n_bands[0]), F.lit(n_bands[1]))).alias("bands")).select("bands", F.explode(F.sequence(F.lit(rows[0]), F.lit(rows[1]))).alias("rows"))
    p = lambda s: 1 - F.pow(1 - F.pow(F.lit(s), F.col("rows")), F.col("bands"))
    return grid.select("bands", "rows", F.round(p(high[0]), 9).alias("p_high"), F.round(p(low[0]), 9).alias("p_low")).where((F.col("p_high") >= high[1]) & (F.col("p_low") < low[1]))


def signature_size(error: float) -> int:
    """How many hash functions give an expected error."""
    if not 0 < error < 1:
        raise ValueError("the error lies between 0 and 1")
    return int(1 / error**2)


def expected_error(n: int) -> float:
    return 1 / math.sqrt(n)


def lsh_size(stages: int, threshold: float = 0.5) -> int:
    """The signature's length so that sets of the threshold's similarity meet in one of the stages."""
    rows = math.ceil(math.log(1 / stages) / math.log(threshold)) + 1
    return rows * stages
