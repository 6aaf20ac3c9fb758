"""A deterministic sharded WARC writer and its reader.

Pages are cut into key ranges (shards) at bounds taken from the keys alone, so the same pages give the same files on any
cluster. Each shard is sorted by key and streams through one task into gzip files (one member per record) that are closed
once they reach ``roll_bytes`` compressed. Headers and digests are made anew for every record. Records with equal payloads
become one response, of the smallest key, and revisits of it.

Files are written under temporary names that carry the task attempt. The rows that the tasks return form the manifest, which
Spark writes with its own commit, so of several attempts only the one that counts is listed. A second job moves the listed
files to their final names, and the manifest is published last. Readers follow the manifest; files that are not listed are leftovers
of lost attempts. File access goes through ``pyarrow.fs``, so the target may be any shared store that it knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import small_batches, stored, text_or_empty

ROLL_BYTES = 8_000_000
SAMPLED = 200_000  # keys that the driver sees; more shards than that grow beyond ``shard_rows`` instead
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """One header line: line breaks and other control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A WARC 1.1 record; a revisit keeps the HTTP head (with the payload's length) and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a gzip archive; lengths and block digests are checked."""
    with gzip.open(io.BytesIO(archive)) as stream:
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError("not a WARC record")
            head = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            block = stream.read(int(head["Content-Length"]))
            if stream.read(4) != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError("damaged WARC record")
            yield head, block


def _bounds(keys: DataFrame, shards: int) -> list[int]:
    """Keys at which shards begin: quantiles of a sample that depends on the keys only (about 64 keys a shard, SAMPLED at most)."""
    n = keys.count()
    step = max(1, n // min(64 * shards, SAMPLED))
    picked = keys.filter(F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0).filter("page_id is not null")
    found = sorted(r[0] for r in picked.distinct().collect())
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def write(pages: DataFrame, target: str, min_revisit: int = 0, shard_rows: int = 2_000, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below ``target``, a new folder, and return the manifest.

    Null html is an empty payload, a null url leaves the target header out. Of records with equal payloads of at least
    ``min_revisit`` bytes the one with the smallest page_id is the response (null is the largest; among repeated ids the first by
    url) and the others revisit it; smaller payloads are all responses. Shards hold about ``shard_rows`` pages; a page_id that
    repeats more often than that is spread over several shards by payload. Other columns are ignored. An empty table gives an
    empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), text_or_empty("html").cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = rows.select("page_id", "digest", F.length("payload").alias("n"))
    same = ids.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    same = same.filter("copies > 1").select("digest", "first")
    # Every further copy's reference, keyed like the page itself: the writer meets it just before the page.
    marks = ids.filter(F.col("n") >= min_revisit).join(same, "digest").select("page_id", "digest", "first").distinct()
    keys = stored(ids.select("page_id"))
    total = keys.count()
    shards = max(1, math.ceil(total / shard_rows))
    bounds = np.array(_bounds(keys, shards), dtype=np.int64)
    parts = _parts(keys, bounds, shard_rows)

    @F.pandas_udf("long")
    def range_of(page_id: pd.Series) -> pd.Series:
        found = np.searchsorted(bounds, page_id.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(page_id.isna(), len(bounds) + 1, found))

    nothing = F.lit(None)
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", nothing.cast("long").alias("first")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "first"))
    both = both.withColumn("shard", range_of("page_id"))
    # only ranges in which ids repeat beyond the shard size have more than one part
    part = F.lit(0).cast("long")
    for shard, n in parts:
        part = F.when(F.col("shard") == shard, F.pmod(F.xxhash64("digest"), F.lit(n))).otherwise(part)
    both = both.withColumn("part", part).repartition(max(shards, 1), "shard", "part")
    both = both.sortWithinPartitions("shard", "part", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")
    both = both.select("shard", "part", "page_id", "digest", "kind", "url", "payload", "first")
    draft = f"{target}/draft"
    manifest_schema = "name string, draft string, shard long, part long, file int, n_records long, bytes long, sha1 string"

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(draft)
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        out, shard, file, n, size, sha = None, None, 0, 0, 0, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                name = f"{shard[0]:08d}-{shard[1]:04d}-{file:05d}.warc.gz"
                done.append((name, f"{attempt}-{name}", shard[0], shard[1], file, n, size, sha.hexdigest()))
                out = None

        reference, seen = None, None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    reference, seen = row["first"], (key, False)
                    continue
                if (row["shard"], row["part"]) != shard:
                    close()
                    shard, file = (row["shard"], row["part"]), 0
                first = None
                if seen is not None and seen[0] == key:  # copies exist
                    if reference is not None and (reference != row["page_id"] or seen[1]):
                        first = reference
                    seen = (key, True)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{attempt}-{shard[0]:08d}-{shard[1]:04d}-{file:05d}.warc.gz", compression=None)
                    n, size, sha = 0, 0, hashlib.sha1()
                data = gzip.compress(record(row["page_id"], row["url"], row["payload"], first, date), 6, mtime=0)
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    file += 1
        close()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=[f.split()[0] for f in manifest_schema.split(", ")]).astype({"file": "int32"}), preserve_index=False)

    both.mapInArrow(write_files, manifest_schema).write.mode("errorifexists").parquet(f"{target}/draft-manifest")
    listed = spark.read.parquet(f"{target}/draft-manifest")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            store.create_dir(f"{root}/warc", recursive=True)
            for row in batch.to_pylist():
                final = f"{root}/warc/{row['name']}"
                if store.get_file_info(final).type == fs.FileType.NotFound:  # a repeated attempt finds it in place
                    store.move(f"{root}/draft/{row['draft']}", final)
            yield batch

    files = listed.repartition(spark.sparkContext.defaultParallelism, "name").mapInArrow(publish, manifest_schema)
    files.drop("draft").write.mode("errorifexists").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def _parts(keys: DataFrame, bounds: np.ndarray, shard_rows: int) -> list[tuple[int, int]]:
    """(shard, parts) of the few ranges that one repeated page_id overfills: at most total / (4 * shard_rows) of them."""
    heavy = keys.groupBy("page_id").count().filter(F.col("count") > 4 * shard_rows).collect()
    found: dict[int, int] = {}
    for r in heavy:
        shard = len(bounds) + 1 if r["page_id"] is None else int(np.searchsorted(bounds, r["page_id"], side="right"))
        found[shard] = found.get(shard, 0) + math.ceil(r["count"] / shard_rows)
    return sorted(found.items())


def read(spark: SparkSession, target: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null in revisits) of every record.

    Files are read whole by Spark's own reader (they are bounded by the roll size plus one record) and only if the manifest lists them.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    listed = spark.read.parquet(f"{target}/manifest").select("name")
    if listed.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{target}/warc")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("name", "content").join(listed, "name", "left_semi")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows, held = [], 0
                for head, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    kind = head["WARC-Type"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError("payload differs from its digest")
                    page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
                    rows.append((page and int(page), head.get("WARC-Target-URI"), kind, length, digest, refers and int(refers), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(parse, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
