"""Bloom filters: built by an aggregate, saved and loaded as Parquet, and asked in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sizing(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n members and a share p of false positives."""
    bits = max(1, int(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits * math.log(2) / n))


def places(key: Column, bits: int, hashes: int) -> Column:
    """The key's bits, by double hashing."""
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    return F.array(*(F.pmod(one.bitwiseAND((1 << 40) - 1) + i * two.bitwiseAND((1 << 20) - 1), F.lit(bits)) for i in range(hashes)))


def build(df: DataFrame, key: Column, *, n: int, p: float = 0.03) -> DataFrame:
    """(slot, word): the filter's 64-bit words that aren't 0. It has ``sizing(n, p)`` bits, whatever the rows."""
    bits, hashes = sizing(n, p)
    set_bits = df.where(key.isNotNull()).select(F.explode(places(key, bits, hashes)).alias("bit"))
    return set_bits.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("bit"), F.lit(64)).cast("int"))).alias("word"))


def saved(filter_words: DataFrame, path: str, *, n: int, p: float = 0.03) -> None:
    """Write a filter with the numbers that it was made for."""
    filter_words.select("slot", "word", F.lit(n).cast("long").alias("n"), F.lit(p).alias("p")).write.parquet(path)


def loaded(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """A filter that was saved, with its n and p; one without members may have any."""
    found = spark.read.parquet(path)
    first = found.select("n", "p").first()
    return found.select("slot", "word"), *(first or (1, 0.03))


def maybe_member(spark: SparkSession, filter_words: DataFrame, key: Column, *, n: int, p: float = 0.03, most_bits: int = 1 << 28) -> Column:
    """Whether the key may be a member: never false for one. The filter is collected, ``most_bits`` at most, and broadcast."""
    bits, hashes = sizing(n, p)
    if bits > most_bits:
        raise ValueError(f"a filter of {bits} bits is too large to broadcast; use a semi join")
    words, found = np.zeros(bits // 64 + 1, np.int64), filter_words.select("slot", "word").toArrow()
    words[found["slot"].to_numpy()] = found["word"].to_numpy()
    held = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def ask(at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=bool)
        x = np.stack(at.to_numpy())
        return pd.Series(((held.value[x // 64].view(np.uint64) >> (x % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1))

    return ask(places(key, bits, hashes))


def semi_join(left: DataFrame, right: DataFrame, key: str, *, n: int, p: float = 0.03, path: str | None = None) -> DataFrame:
    """The rows of ``left`` whose key is in ``right``, exactly: the filter drops most others before the join's exchange.

    With a path the filter is saved there and loaded again, for other jobs to use.
    """
    words = build(right, F.col(key), n=n, p=p)
    if path:
        saved(words, path, n=n, p=p)
        words, n, p = loaded(left.sparkSession, path)
    return left.where(maybe_member(left.sparkSession, words, F.col(key), n=n, p=p)).join(right.select(key), key, "left_semi")
