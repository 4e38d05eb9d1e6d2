"""A data source of invented words: ``spark.read.format("words").option("records", n).option("splits", k)``.

A word hangs on the seed and its place alone, so each split makes its own range and any number of splits gives the same rows.
With the option ``sharding`` as ``hash`` each split makes all words and keeps those whose hash falls to it, so that equal words
lie in one split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LETTERS, LENGTH = 26, 5


def word(seed: int, at: int) -> str:
    """Five letters A-Z."""
    n = int(hashlib.md5(f"{seed}:{at}".encode()).hexdigest()[:8], 16)
    return "".join(chr(65 + n // LETTERS**k % LETTERS) for k in range(LENGTH))


def shard(text: str, shards: int) -> int:
    """The shard of an ASCII word by its polynomial hash (base 31, 32 bits)."""
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) % (1 << 32)
    return h % shards


class WordReader(DataSourceReader):
    def __init__(self, records: int, splits: int, seed: int, size: int, by_hash: bool) -> None:
        if splits < 1:
            raise ValueError("at least one split")
        self.records, self.splits, self.seed, self.size, self.by_hash = records, splits, seed, size, by_hash

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.splits)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        k = partition.value
        if self.by_hash:
            yield from ((i * self.size, w) for i in range(self.records) if shard(w := word(self.seed, i), self.splits) == k)
            return
        for i in range(self.records * k // self.splits, self.records * (k + 1) // self.splits):
            yield i * self.size, word(self.seed, i)


class Words(DataSource):
    """(position, word): position is the row's number times the record size."""

    @classmethod
    def name(cls) -> str:
        return "words"

    def schema(self) -> str:
        return "position long, word string"

    def reader(self, schema) -> WordReader:
        get = lambda key, default: int(self.options.get(key, default))
        return WordReader(get("records", 1), get("splits", 1), get("seed", 1), get("record_size", LENGTH + 1), self.options.get("sharding", "range") == "hash")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Words)
