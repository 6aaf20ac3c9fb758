"""Base spans against a plain scan with the contract's patterns; the added spans, thresholds and edge cases."""

import hashlib
import re
from collections import Counter

import pytest

from notelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(kind, m.group())]
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    counts = Counter(f[3] for f in found)
    return (*(counts[k] for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), {x for x in joined.split(",") if x})


def check(df, rows):
    found = pii.find(df)
    got = pii.digests(found).collect()
    want = Counter((i, *brute(t or "")[:5]) for i, t in rows)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by = {i: brute(t or "")[5] for i, t in rows}
    if len(by) == len(rows):
        for r in got:
            spans = set(filter(None, r.spans.split(",")))
            assert by[r.doc_id] <= spans and len(spans) == len(by[r.doc_id]) + r.n_added
    return got


TRICKY = [
    "a@b.c", "x a@b.c_d@e.fg y", "é😀 me@host.example.com, you+1@x-y.z.w", "a.b@c", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 001.002.003.0004",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "41111111111111114111111111111111", "4111  1111 1111 1111", "+1 (988) 555-2485 +12345", "++1 202 555 0100.",
    "99999999999999999999.1.1.1", "+1" * 40, "@" * 50, "a" * 3000 + "@b.c", "1-2 3-4 5-6 7-8 9-0 1-2 3-4", "write to joe (at) mail (dot) example (dot) com",
]


def test_tricky_texts_and_edges(spark, edge_docs, no_docs):
    rows = list(enumerate(TRICKY))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert pii.digests(pii.find(no_docs)).count() == 0


def test_very_long_runs(spark):
    """Runs that a recursive matcher overflows on."""
    rows = [
        ("7" * 200_000, 0), ("1 " * 100_000, 0), ("a@" + "b." * 50_000 + "c", 1), ("x at " + "yy dot " * 20_000 + "zz", 0), (" " * 200_000, 0),
        ("+" * 100_000, 0), ("+1" + "(" * 50_000 + "2" * 50_000, 0), ("1." * 20_000, 0), ("1()2." * 40_000 + "3", 0), ("a" * 200_000 + "@", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_email, r.n_card, r.n_phone) for r in pii.digests(pii.find(df)).collect()}
    assert got == {i: (n, 0, 0) for i, (_, n) in enumerate(rows)}


def test_given_documents_and_redaction(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = check(df, rows)
    clean = [r for r in got if not re.search("[0-9@]", dict(rows)[r.doc_id] or "")]
    assert clean and all(not r.spans for r in clean)
    few = df.filter("doc_id < 60")
    found = pii.find(few)
    spans = {r.doc_id: r.spans for r in found.collect()}
    out = {r.doc_id: r.text for r in pii.redacted(few, found).collect()}
    for doc_id, text in rows:
        if doc_id < 60:
            want, at = "", 0
            for s in spans[doc_id]:
                if s.start >= at:
                    want += text[at:s.start] + f"[{pii.KINDS[s.kind]}]"
                at = max(at, s.end)
            assert out[doc_id] == want + text[at:]


def test_luhn(spark):
    df = spark.createDataFrame([("4111111111111111",), ("79927398713",), ("79927398710",), ("",)], "d string")
    assert [r[0] for r in df.select(pii.luhn(df.d)).collect()] == [True, True, False, False]
    assert valid("card", "4111111111111111") and pytest


WIDE = [
    ("write to joe (at) mail (dot) example (dot) com", "email:9:46"), ("ask anna[at]post.example.org now", "email:4:28"),
    ("bob at mail dot example dot net please", "email:0:31"), ("see max at host.example.com", "email:4:27"),
    ("call (743) 555-3824 now", "phone:5:19"), ("our 743-555-3824 now", "phone:4:16"), ("our 1 743 555 3824 ok", "phone:4:18"),
    ("pay 4111.1111.1111.1111 ok", "card:4:23"), ("pay 4111/1111/1111/1111 ok", "card:4:23"), ("at 10_120_30_140 up", "ip:3:16"),
]
CLEAN = ["we meet at noon. Then home", "look at eron. By the way", "no 4111.1111.1111.1112", "at 300_120_30_140", "of 12345678901 x", "list 1, 2, 3, 4 end", "part 12 34 56"]


def test_planted_wide_spans_are_added_and_clean_ones_are_not(spark):
    rows = [(-1 - i, t) for i, t in enumerate([t for t, _ in WIDE] + CLEAN)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pii.digests(pii.find(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    assert [(t, got[i].spans) for (i, t), _ in zip(rows, WIDE)] == WIDE and all(got[-1 - i].n_added == 1 for i in range(len(WIDE)))
    assert [(t, got[i].spans) for i, t in rows[len(WIDE):]] == [(t, "") for t in CLEAN]
    assert sum(r.n_added for i, r in got.items() if i >= 0) <= 5  # the table holds hardly any itself
