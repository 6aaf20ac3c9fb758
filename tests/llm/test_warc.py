"""Archives: written, read back and compared with a plain loop; determinism and leftovers."""

import gzip
import hashlib
import os
from collections import Counter, defaultdict

import duckdb

from notelake.llm import warc

SCHEMA = "page_id long, url string, html string, shard string, digest string"


def brute(rows, min_revisit=0):
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[html or ""].append((page is None, page or 0, url is not None, url or ""))
    out = Counter()
    for html, copies in groups.items():
        data = html.encode()
        first = min(copies)
        for i, (no_id, page, *_) in enumerate(sorted(copies)):
            revisit = len(copies) > 1 and len(data) >= min_revisit and i > 0 and not first[0]
            out[None if no_id else page, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", first[1] if revisit else None] += 1
    return out


def check(spark, rows, target, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    manifest = warc.write(df, target, **options)
    got = warc.read(spark, target)
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert Counter(tuple(r)[:5] for r in found) == brute(rows, options.get("min_revisit", 0))
    assert manifest.count() == len(manifest.select("name").distinct().collect())
    return manifest


def test_given_pages_roll_and_repeat(spark, tmp_path):
    rows = duckdb.sql("select page_id, url, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    rows += [(i + 10_000, u, h) for i, u, h in rows[::3]]
    files = []
    for run in ("a", "b"):
        manifest = check(spark, rows, f"file://{tmp_path}/{run}", shard_rows=40, roll_bytes=20_000)
        files.append(sorted((r["name"], r["sha1"], r["bytes"]) for r in manifest.collect()))
        assert len(files[-1]) > 10
        for name, sha1, size in files[-1]:
            data = open(f"{tmp_path}/{run}/warc/{name}", "rb").read()
            assert (hashlib.sha1(data).hexdigest(), len(data)) == (sha1, size)
    assert files[0] == files[1]  # the same names and bytes


def test_edges(spark, tmp_path):
    big = "long " * 100_000
    rows = [(1, "http://a/", "same"), (0, "http://b/", "same"), (0, "http://c/", "same"), (2, None, None), (3, "u", ""), (None, None, "same"),
            (None, "only without id", "lonely"), (4, "line\r\nWARC-Type: evil\x00", "WARC/1.1\r\n\r\nx"), (5, "é", big), (-6, "u", big), (7, "u", "\r\n\r\n")]
    check(spark, rows, f"file://{tmp_path}/e")
    check(spark, rows, f"file://{tmp_path}/m", min_revisit=5)
    check(spark, [], f"file://{tmp_path}/n")


def test_repeated_id_is_spread(spark, tmp_path):
    rows = [(7, f"u{i}", f"page {i % 40}") for i in range(120)] + [(i, "u", f"page {i}") for i in range(30)]
    manifest = check(spark, rows, f"file://{tmp_path}/h", shard_rows=10)
    assert manifest.filter("part > 0").count() > 0


def test_unlisted_files_are_not_read(spark, tmp_path):
    check(spark, [(1, "u", "x")], f"file://{tmp_path}/u")
    before = warc.read(spark, f"file://{tmp_path}/u").count()
    with open(os.path.join(tmp_path, "u", "warc", "stray.warc.gz"), "wb") as out:
        out.write(gzip.compress(warc.record(9, "u", b"stray")))
    assert warc.read(spark, f"file://{tmp_path}/u").count() == before
