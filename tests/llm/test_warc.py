from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter

from pyspark.sql import functions as F

from lodeflow.llm import warc

ROWS = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (3, "http://a/3", "same"), (7, "http://a/\r\n7", ""), (8, "http://a/8", None),
    (-2, "u", "é😀\r\n\r\nx"), (4, "u", "x" * 300_000), (6, "u", "Z" * 300_000), (3, "other", "different"), (None, "n", "lonely"), (None, "n", "lonely"), (None, "n", "same"), (1 << 62, "far", "y"), (-(1 << 62), "far", "y"),
]


def want(rows):
    rows = [(i, h.encode() if h else b"") for i, _, h in rows]
    least: dict[bytes, int] = {}
    for i, p in rows:
        if i is not None:
            least[p] = min(i, least.get(p, i))
    out, seen = [], set()
    for i, p in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        copy = p in least and i != least[p] or (i, p) in seen
        seen.add((i, p))
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if copy else "response", least.get(p, i) if copy else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def files(spark, out):
    return {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{out}/*.warc.gz").collect()}


def test_round_trip_and_determinism(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    seen = []
    for d in (df, df.orderBy(F.desc("url")).repartition(3)):
        out = warc.new_folder(spark)
        manifest = warc.write(d, out, shard_bytes=200_000, file_bytes=300)
        assert got(warc.read(manifest, out)) == want(ROWS)
        found = files(spark, out)
        assert {r.name: (r.bytes, r.sha256) for r in manifest.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in found.items()}
        seen.append(found)
    assert seen[0] == seen[1] and len(seen[0]) > 4


def test_empty_and_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    out = warc.new_folder(spark)
    assert warc.read(warc.write(df, out), out).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = warc.new_folder(spark)
    assert got(warc.read(warc.write(pages, out), out)) == want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_limits_refine_clumped_ids_and_split_heavy_ones(spark):
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, 10, sha(i)) for i in range(1000)] + [(1 << 40, 10, sha(0))] + [(500, 10, sha(i)) for i in range(400)] + [(None, 10, sha(i)) for i in range(300)]
    cuts = warc.limits(spark.createDataFrame(rows, "page_id long, size long, digest string"), 1000)
    at = Counter(bisect_right(cuts, (i is not None, i or 0, int(d[:15], 16))) for i, _, d in rows)
    assert cuts == sorted(cuts) and 10 * max(at.values()) <= 1000 and len(cuts) <= 50 and sum(at.values()) == len(rows)


def test_heavy_ids_and_nulls_lie_in_several_shards(spark):
    rows = [(None if i % 3 else 7, "u", f"{i}" * 300) for i in range(200)] + [(None, "u", "copy")] * 5 + [(9, "u", "copy")]
    out = warc.new_folder(spark)
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), out, shard_bytes=20_000)
    assert got(warc.read(manifest, out)) == want(rows) and manifest.select("shard").distinct().count() > 5
