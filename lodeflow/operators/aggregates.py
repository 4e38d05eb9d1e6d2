"""Aggregations by key; all combine before their exchange unless their text says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodeflow.functions import exprs


def sum_by(df: DataFrame, keys: list[Column], value: Column, *, as_name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(as_name))


def max_by(df: DataFrame, keys: list[Column], value: Column, keep: Column, *, as_name: str = "most") -> DataFrame:
    """The largest value by key of the rows that ``keep`` accepts."""
    return df.where(keep).groupBy(*keys).agg(F.max(value).alias(as_name))


def count_where(df: DataFrame, keys: list[Column], keep: Column) -> DataFrame:
    return df.where(keep).groupBy(*keys).agg(F.count("*").alias("n"))


def counted(df: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    """The rows that ``keep`` accepts, and an observation of ``calls`` (all rows) and ``writes`` (accepted ones).

    The observation is filled when the frame has been written; retried tasks count once.
    """
    seen = Observation()
    return df.observe(seen, F.count("*").alias("calls"), F.count_if(keep).alias("writes")).where(keep), seen


def density(df: DataFrame, keys: list[Column], one: Column, other: Column) -> DataFrame:
    """Rows by key over the product of its numbers of distinct values of two columns."""
    return df.groupBy(*keys).agg((F.count("*") / (F.count_distinct(one) * F.count_distinct(other))).alias("density"))


def fm_distinct(df: DataFrame, keys: list[str], word: Column) -> DataFrame:
    """Flajolet-Martin estimates of the distinct words by key.

    Words repeat, and their hash costs far more than a lookup: each is hashed once, after its copies are combined.
    """
    each = df.select(*keys, word.alias("_w")).distinct()
    bits = each.select(*keys, exprs.lowest_bit(exprs.unsigned_hash(F.col("_w"))).alias("bit")).groupBy(*keys).agg(F.bit_or("bit").alias("bits"))
    return bits.select(*keys, exprs.fm_estimate(F.col("bits")).alias("estimate"))


def top_k(df: DataFrame, by: str, ties: str, k: int, *, ascending: bool = False, padded: bool = False) -> DataFrame:
    """The k rows (ties, by) or more columns with the largest ``by``, of ties the smallest key; each task keeps k rows.

    ``ascending`` gives them from the least on; ``padded`` fills up to k rows with zeros, for frames of numbers.
    """
    out = df.orderBy(F.desc(by), F.asc(ties)).limit(k)
    if padded:
        zeros = df.sparkSession.range(k).select(*(F.lit(0).cast(f.dataType).alias(f.name) for f in df.schema))
        own, fill = out.withColumn("fill", F.lit(0)), zeros.withColumn("fill", F.lit(1))
        out = own.unionByName(fill).orderBy("fill", F.desc(by), F.asc(ties)).limit(k).drop("fill")
    return out.orderBy(F.asc(by), F.desc(ties)) if ascending else out


def frequency_of_frequencies(df: DataFrame, value: Column) -> DataFrame:
    """(times, n): how many values are found how often."""
    return df.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n"))


def histograms(df: DataFrame, key: str, bucket: Column, *, as_name: str = "histogram") -> DataFrame:
    """Each key's buckets with their counts as text, ``bucket:n`` by bucket with tabs between."""
    each = df.select(key, bucket.alias("b")).groupBy(key, "b").agg(F.count("*").alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("b", "n")))
    return each.groupBy(key).agg(F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["b"].cast("string"), c["n"].cast("string"))), "\t").alias(as_name))


def palindrome_pairs(df: DataFrame, text: str, *, shortest: int = 3) -> DataFrame:
    """(token, hi, lo): words whose reverse is found, too, or that are palindromes, with the counts of both directions.

    Tokens are lower-cased; those with a digit are left out, other signs are stripped. The more frequent direction is shown,
    that earlier in code-point order where both are equal.
    """
    raw = df.select(F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")).alias("raw")).where(~F.col("raw").rlike("[0-9]"))
    words = raw.select(F.regexp_replace("raw", r"[^\p{L}]", "").alias("w")).where(F.length("w") >= shortest)
    same = F.col("w") == F.least("w", F.reverse("w"))
    both = words.groupBy(F.least("w", F.reverse("w")).alias("k")).agg(F.count_if(same).alias("f"), F.count_if(~same).alias("r"))
    both = both.where(((F.col("f") > 0) & (F.col("r") > 0)) | (F.col("k") == F.reverse("k")))
    return both.select(F.when(F.col("f") < F.col("r"), F.reverse("k")).otherwise(F.col("k")).alias("token"), F.greatest("f", "r").alias("hi"), F.least("f", "r").alias("lo"))


def neighbours(df: DataFrame, text: str, *, distance: int = 3, least: int = 2) -> DataFrame:
    """(word, neighbour, n): words that stand at most ``distance`` places apart in a line, ``least`` times or more.

    Pairs are made inside the row, so their number grows with the text; both directions are counted as one, and only those
    found often enough are turned. ``neighbour`` is the word's 32-bit hash. A word isn't its own neighbour.
    """
    lines = df.select(F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line")).select(exprs.letters(F.col("line")).alias("w")).where(F.size("w") > 1)
    ahead = F.array(*(F.get("w", F.col("i") + d) for d in range(1, distance + 1)))
    pairs = lines.select("w", F.posexplode("w").alias("i", "x")).select("x", F.explode(ahead).alias("y")).where("x <> y")
    found = pairs.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = found.select(F.explode(F.array(F.struct("x", "y", "n"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "n"))).alias("p")).select("p.*")
    return both.select(F.col("x").alias("word"), exprs.java_hash(F.col("y")).alias("neighbour"), "n").groupBy("word", "neighbour").agg(F.sum("n").alias("n"))


def neighbour_arrays(found: DataFrame) -> DataFrame:
    """(word, neighbours): each word's neighbours of (word, neighbour, n) as one array, sorted by hash."""
    return found.groupBy("word").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def collected(df: DataFrame, key: str, value: Column, *, as_name: str = "values") -> DataFrame:
    """A key's values, sorted, as one string. For keys with few rows: a key's values meet in one task."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda v: v.cast("string")), " ").alias(as_name))
