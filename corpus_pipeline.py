"""The training-data pipeline: rules, near-duplicates, benchmark passages, personal data, mixture.

Each stage works on all documents that its predecessor kept, and its result is written as Parquet before the next one reads
it. All but the last return the columns of documents; the last adds ``copies``, how often the mix takes the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lodeflow.functions.tables import table
from lodeflow.llm import automaton, fertility, minhash, mixing, pii
from lodeflow.llm.common import BATCH_ROWS, free_name, removed, shared_dir, short_batches, stored, workspace


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their language's bands go."""
    short_batches(spark)
    return fertility.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, one with the group's smallest id; shingles of five words, a similarity of 0.8.

    Rows without an id or without words stay. An id found once is decided by id alone. Rows that repeat an id are decided each by
    its own text: of those in one group the text with the least digest stays, of equal shingle sets the first row by its columns.
    """
    short_batches(spark)
    out = minhash.near_duplicates(docs, words=5, percent=80, bands=32, rows=5).where("doc_id is not null")
    ids = out.groupBy("doc_id").agg(F.count("*").alias("times"), F.max(~F.col("kept") & F.col("node").isNotNull()).alias("goes"))
    ids = stored(ids.where("times > 1 or goes"))
    id_, node = free_name(docs.columns, "id"), free_name(docs.columns, "node")
    own = docs["doc_id"].cast("long")
    listed = lambda df: df.select(F.col("doc_id").alias(id_))
    left = docs.join(listed(ids), own == F.col(id_), "left_anti")
    several = ids.where("times > 1")
    if several.isEmpty():
        return left
    some = minhash.with_nodes(docs.join(listed(several), own == F.col(id_), "left_semi"), words=5, name=node)
    stays = out.where("kept and node is not null").join(several, "doc_id", "left_semi").groupBy("doc_id", "component").agg(F.min("node").alias("least"))
    ordered = F.struct("text", *(f.name for f in docs.schema if isinstance(f.dataType, AtomicType)))
    first = some.join(stays.select(F.col("doc_id").alias(id_), "least"), (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(node) == F.col("least")), "left_semi")
    first = first.groupBy("doc_id", node).agg(F.min_by(F.struct(*docs.columns), ordered).alias("row")).select("row.*")
    return left.unionByName(first).unionByName(some.where(F.col(node).isNull()).drop(node))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are taken out of the texts; documents that are mostly such passages go."""
    short_batches(spark)
    return _measured(automaton.cleaned(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(pii.redacted(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
]

#: Bands of tokenisers, iterated scores and the cube method have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What the stages store on their way is removed; the session's settings stay as they were."""
    docs, before, rows = table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH_ROWS)
    try:
        for _, stage in STAGES:
            path = shared_dir(spark)
            with workspace(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return docs
