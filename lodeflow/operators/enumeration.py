"""Hash puzzles: permutations, hints by hash, and passwords among all strings of an alphabet.

The number of strings hangs on the alphabet and the length, which are parameters; both tables are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST = 10_000_000


def strings(spark: SparkSession, letters: int, length: int) -> DataFrame:
    """(s): all strings of the first letters, made from their numbers in that base."""
    if letters**length > MOST:
        raise ValueError(f"{letters}**{length} strings are more than {MOST}")
    digit = lambda k: F.pmod(F.floor(F.col("id") / letters ** (length - 1 - k)), F.lit(letters))
    return spark.range(letters**length).select(F.concat(*(F.substring(F.lit(ALPHABET), digit(k).cast("int") + 1, F.lit(1)) for k in range(length))).alias("s"))


def permutations(spark: SparkSession, letters: int) -> DataFrame:
    """(s, missing): each order of the letters without one of them, with the missing one."""
    every = strings(spark, letters, letters - 1)
    chars = F.filter(F.split("s", ""), lambda c: c != "")
    missing = F.array_except(F.array(*(F.lit(c) for c in ALPHABET[:letters])), chars)
    return every.where(F.size(F.array_distinct(chars)) == letters - 1).select("s", F.element_at(missing, 1).alias("missing"))


def hints(spark: SparkSession, puzzles: DataFrame, letters: int) -> DataFrame:
    """(id, hint): the letter that each known hint hash of (id, main, hints) rules out."""
    known = permutations(spark, letters).select(F.sha2("s", 256).alias("hash"), F.col("missing").alias("hint"))
    return puzzles.select("id", F.explode("hints").alias("hash")).join(known, "hash").select("id", "hint").distinct()


def looked_up(spark: SparkSession, puzzles: DataFrame, letters: int) -> DataFrame:
    """(id, value): each puzzle's main hash and its hints' letters."""
    return puzzles.select("id", F.col("main").alias("value")).unionByName(hints(spark, puzzles, letters).select("id", F.col("hint").alias("value")))


def solved(spark: SparkSession, puzzles: DataFrame, letters: int, length: int) -> DataFrame:
    """(id, password): strings with the main hash that have no letter that a hint rules out."""
    out = hints(spark, puzzles, letters).groupBy("id").agg(F.collect_set("hint").alias("ruled"))
    all_strings = strings(spark, letters, length).select("s", F.sha2("s", 256).alias("main"))
    found = puzzles.select("id", "main").join(all_strings, "main").join(out, "id", "left")
    clash = F.arrays_overlap(F.split("s", ""), F.coalesce("ruled", F.array().cast("array<string>")))
    return found.where(~clash).select("id", F.col("s").alias("password"))
