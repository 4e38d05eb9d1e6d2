"""Deterministic sharded WARC writer and its reader.

Records are sorted by id and payload digest and dealt into shards by ranges of about equal payload size; the limits come from a
histogram of the ids, and for an id that is too heavy by itself (null among them) of its digests, refined where a bucket is too
heavy, so they depend on the rows alone. Pages are shuffled once, each shard to the task of its number, sorted there, and
streamed into gzip members, one a record; a file is closed when its compressed size reaches a limit. Headers (lengths, dates,
ids) and digests are made anew from the payload. Of equal payloads that with the smallest id is a response, others are revisit
records without it. Which ids are copies is found from ids and digests alone; those rows travel in the same exchange as the
pages, so no join moves a payload, and a task holds one record at a time.

A writer's file has a temporary name of its own. The names that Spark's commit of the manifest keeps are then renamed, by
steps that may run twice; readers take the files of the manifest only. So a lost or repeated task leaves nothing behind but a
temporary file, which the end of the write removes.

Defined cases: a null payload is empty, and all empty ones are copies of each other; rows that repeat an id and a payload are
a response and revisits of the same id, in order of their URL, and stay in one shard; null ids sort first, are responses where
no row with an id has their payload, and read back as null; a very long payload is one record of its own; an empty table gives a
manifest without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm.common import pieces, removed, shared_dir, stored

#: Tasks of a write or read at most; with more shards a task takes several that follow each other.
MOST_TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
NO_LINE = {ord(c): "%0D" if c == "\r" else "%0A" for c in "\r\n"}
MANIFEST = "shard long, part long, name string, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def keyed(pages: DataFrame) -> DataFrame:
    """(page_id, size, digest) of each page; the digest is hexadecimal."""
    return pages.select(F.col("page_id").cast("long"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"), _sha1("html").alias("digest"))


def _sha1(column: str) -> Column:
    return F.sha1(F.coalesce(F.col(column), F.lit("")).cast("binary"))


#: Leading bits of a digest, as a number, by which the rows of one id are told apart.
MARK_BITS = 60


def _mark(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, MARK_BITS // 4), 16, 10).cast("long")


def _histogram(rows: DataFrame, by: list[str], value: Column, most: int, finer: int) -> list[tuple]:
    """(by, start of a range of ``value``, size): ranges from (by, value, size, shift), refined while they hold more than ``most``."""
    rows, out = rows.select(*by, value.alias("value"), "size", "shift"), []
    while True:
        at = F.call_function("shiftright", F.col("value"), F.col("shift"))
        found = rows.groupBy(*by, "shift", at.alias("at")).agg(F.sum("size").alias("bytes")).collect()
        heavy = [r for r in found if r["bytes"] > most and r["shift"]]
        out += [(*(r[c] for c in by), r["at"] << r["shift"], r["bytes"]) for r in found if not (r["bytes"] > most and r["shift"])]
        if not heavy:
            return out
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
        marks = rows.sparkSession.createDataFrame([(*(r[c] for c in by), r["shift"], r["at"]) for r in heavy], f"{kinds}{', ' if by else ''}old int, mark long")
        marks = F.broadcast(marks.select(*(F.col(c).alias(f"mark_{c}") for c in by), "old", "mark"))  # no more rows than shards
        met = (F.col("shift") == F.col("old")) & (at == F.col("mark"))
        for c in by:
            met = met & F.col(c).eqNullSafe(F.col(f"mark_{c}"))
        rows = rows.join(marks, met).select(*by, "value", "size", F.greatest(F.lit(0), F.col("shift") - finer).cast("int").alias("shift"))


def limits(ids: DataFrame, most: int, *, finer: int = 4) -> list[tuple[bool, int, int]]:
    """Where a new shard starts, as (whether there is an id, id, mark of the digest), so that a shard holds about ``most`` bytes.

    Only rows equal in id and mark can't be split. Collected are the buckets of the histograms: about eight for each shard at
    most, and 2**finer for each bucket that is refined.
    """
    low, high, total, null = ids.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    sizes: dict[tuple[bool, int, int], int] = {}
    heavy = []
    if low is not None:
        shift = max(0, ((high - low) // max(64, 4 * total // most)).bit_length())
        for at, size in _histogram(ids.where("page_id is not null").withColumn("shift", F.lit(shift)), [], F.col("page_id"), most, finer):
            if size > most:
                heavy.append((at, size))
            else:
                sizes[True, at, -1] = size
    if null is not None:
        if null > most:
            heavy.append((None, null))
        else:
            sizes[False, 0, -1] = null
    if heavy:
        marks = [(a, max(0, MARK_BITS - (8 * n // most).bit_length())) for a, n in heavy]
        named = F.broadcast(ids.sparkSession.createDataFrame(marks, "heavy long, shift int"))  # no more rows than shards
        rows = ids.join(named, ids["page_id"].eqNullSafe(named["heavy"]))
        for at, mark, size in _histogram(rows, ["page_id"], _mark(F.col("digest")), most, finer):
            sizes[at is not None, at or 0, mark] = size
    cuts, now = [], 0
    for at in sorted(sizes):
        if now and now + sizes[at] > most:
            cuts.append(at)
            now = 0
        now += sizes[at]
    return cuts


def record(kind: str, name: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, n: int, url: str | None, payload: bytes, own: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of the response of ``refers_to``; n numbers the records of one id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.insert(0, ("WARC-Target-URI", url.translate(NO_LINE)))
    if revisit:
        headers += [("WARC-Refers-To", f"<{_name(refers_to, own, 0)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record("revisit" if revisit else "response", _name(page_id, own, n), date, headers, block)


def _name(page_id: int | None, own: str, n: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{own}:{n}"


def _files(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Roll:
    """Files of one shard, closed at a compressed size."""

    def __init__(self, out: str, most: int, date: str) -> None:
        self.files, self.root = _files(out)
        self.most, self.date, self.sink, self.at = most, date, None, (-1, -1)

    def put(self, shard: int, member: bytes) -> Iterator[tuple]:
        if self.sink and (shard != self.at[0] or self.bytes >= self.most):
            yield self.close()
        if not self.sink:
            self.at = (shard, self.at[1] + 1 if self.at[0] == shard else 0)
            self.temporary = f"{uuid.uuid4().hex}.tmp"
            self.sink = self.files.open_output_stream(f"{self.root}/_temporary/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
            info = record("warcinfo", f"urn:shard:{self.at[0]}:{self.at[1]}", self.date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self._write(info)
            self.records = 0
        self._write(member)

    def _write(self, member: bytes) -> None:
        self.sink.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.sink.close()
        self.sink = None
        return (*self.at, self.temporary, self.records, self.bytes, self.sha.hexdigest())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def write(pages: DataFrame, out: str, *, shard_bytes: int | None = None, file_bytes: int = 256 << 20, date: str = DATE) -> DataFrame:
    """Write (page_id, url, html) as archives into the new folder ``out``, a URI that all executors reach; returns the manifest.

    A shard holds ``shard_bytes`` of payload, a 64th of all payload by default, within 4 and 512 MB.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    ids = stored(keyed(pages))
    if shard_bytes is None:
        shard_bytes = min(512 << 20, max(4 << 20, (ids.agg(F.sum("size")).first()[0] or 0) >> 6))
    cuts = limits(ids, shard_bytes)
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def shard(i: pd.Series, mark: pd.Series) -> pd.Series:
        there = i.notna()
        return pd.Series([bisect_right(held.value, x) for x in zip(there.tolist(), i.fillna(0).astype("int64").where(there, 0).tolist(), mark.tolist(), strict=True)], dtype="int64")

    copies = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    moved = ids.join(copies, "digest").where("first is not null and not page_id <=> first").select("page_id", "digest", "first").distinct()
    rows = pages.select("page_id", _sha1("html").alias("digest"), F.lit(1).alias("kind"), "url", F.col("html").cast("binary"), F.lit(None).cast("long").alias("first"))
    rows = rows.unionByName(moved.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "first"))
    n, tasks = len(cuts) + 1, min(len(cuts) + 1, MOST_TASKS)
    rows = rows.withColumn("shard", shard("page_id", _mark(F.col("digest"))))
    rows = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / n).cast("int")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, now, n, first = _Roll(out, file_bytes, date), None, 0, None
        for b in pieces(batches):
            done = []
            for page_id, own, kind, url, html, to, at in zip(*(b.column(c).to_pylist() for c in ("page_id", "digest", "kind", "url", "html", "first", "shard")), strict=True):
                if (page_id, own) != now:
                    now, n, first = (page_id, own), 0, None
                if kind == 0:
                    first = to
                    continue
                refers_to = page_id if first is None else first
                done += roll.put(at, page_record(page_id, n, url, html or b"", base64.b32encode(bytes.fromhex(own)).decode(), refers_to, n > 0 or first is not None, date))
                n += 1
            if done:
                yield _batch(done, MANIFEST)
        if roll.sink:
            yield _batch([roll.close()], MANIFEST)

    files, root = _files(out)
    files.create_dir(f"{root}/_temporary", recursive=True)
    made = stored(rows.mapInArrow(put, MANIFEST))

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = _files(out)
        for b in batches:
            done = []
            for r in b.to_pylist():
                name, old = f"shard-{r['shard']:07d}-{r['part']:05d}.warc.gz", f"{root}/_temporary/{r['name']}"
                there = files.get_file_info(old).type == fs.FileType.File
                if there:
                    files.move(old, f"{root}/{name}")
                elif files.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(old)
                done.append((r["shard"], r["part"], name, r["records"], r["bytes"], r["sha256"]))
            yield _batch(done, MANIFEST)

    made.mapInArrow(commit, MANIFEST).write.parquet(f"{out}/manifest")
    removed(spark, f"{out}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    z, got = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            got.append(z.decompress(chunk))
            if not z.eof:
                break
            yield b"".join(got)
            chunk, z, got = z.unused_data, zlib.decompressobj(31), []
    if any(got):
        raise ValueError("the archive ends inside a record")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names, and the version under '') and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {"": version} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def _id(name: str | None) -> int | None:
    found = name.strip("<>").split(":")[2] if name else ""
    return int(found) if found else None


def read_page(headers: dict[str, str], block: bytes) -> tuple | None:
    """READ's columns of a response or revisit; its digests must be right."""
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    own = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-block-digest"] != f"sha1:{digest(block)}" or headers["warc-type"] == "response" and (len(payload), digest(payload)) != (length, own):
        raise ValueError(f"{headers['warc-record-id']} is damaged")
    return (_id(headers["warc-record-id"]), headers.get("warc-target-uri"), length, own, headers["warc-type"], _id(headers.get("warc-refers-to")))


def read(manifest: DataFrame, out: str) -> DataFrame:
    """The pages of the manifest's archives in ``out``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                done = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for member in members(iter(lambda: source.read(1 << 20), b"")):
                        row = read_page(*parsed(member))
                        if row:
                            done.append(row)
                        if len(done) == 1000:
                            yield _batch(done, READ)
                            done = []
                yield _batch(done, READ)

    return manifest.select("name").repartitionByRange(max(1, min(manifest.count(), MOST_TASKS)), "name").mapInArrow(f, READ)


def new_folder(spark: SparkSession) -> str:
    """A folder for archives in the shared folder."""
    return shared_dir(spark)
