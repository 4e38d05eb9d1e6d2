"""The queries of this subpackage and their SQL; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeflow.functions.tables import table
from lodeflow.llm import automaton, chat, crf, fertility, labeller, minhash, mixing, pii, unigram, warc
from lodeflow.llm.common import short_batches


def texts_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; the session sends few of its rows at once to Python."""
    short_batches(spark)
    return table(spark, sf_dir, name)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_cube_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: weights 5, 2, 1 by source, 150 % of all words, twice a document at most."""
    return mixing.mixed(texts_of(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document; labels of documents that aren't held out fit the model."""
    docs = texts_of(spark, sf_dir, "documents")
    return crf.scored(docs, crf.trained(docs, table(spark, sf_dir, "labels")))


def op4_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives into the shared folder, and read back."""
    out = warc.new_folder(spark)
    return warc.read(warc.write(texts_of(spark, sf_dir, "pages"), out), out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1 in five hexadecimal digits, four letters, at once.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform(range(4),
    lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(html), 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return unigram.token_counts(texts_of(spark, sf_dir, "documents"))


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document."""
    return fertility.judged(texts_of(spark, sf_dir, "documents"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents: shingles of three words, a similarity of 0.85."""
    out = minhash.near_duplicates(texts_of(spark, sf_dir, "documents"), words=3, percent=85, bands=24, rows=6)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in WHERE 100 * i >= 85 * (na + nb - i)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u),
least_id AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_id USING (doc_id)
"""


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(texts_of(spark, sf_dir, "documents"))


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in the documents: windows of 13 words, contaminated from 5 % of the words on."""
    return automaton.report(texts_of(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS t FROM b WHERE len(w) > 0
), places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT doc_id, item_id, i, p.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM places) p JOIN windows USING (n, t)
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.typed_turns(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') AS er FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(er) + 2 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return labeller.extracted(texts_of(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixture": op1_cube_mixture,
    "op2_line_crf": op2_line_crf,
    "op3_fertility_rules": op3_fertility_rules,
    "op4_sharded_warc": op4_sharded_warc,
    "op5_trie_token_counts": op5_trie_token_counts,
    "op6_circulant_minhash": op6_circulant_minhash,
    "op7_schema_fingerprint": op7_schema_fingerprint,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_suffix_automaton": op9_suffix_automaton,
    "op10_block_labeller": op10_block_labeller,
}

ORACLES: dict[str, str] = {
    "op4_sharded_warc": OP4_SQL,
    "op6_circulant_minhash": OP6_SQL,
    "op7_schema_fingerprint": OP7_SQL,
    "op9_suffix_automaton": OP9_SQL,
}
