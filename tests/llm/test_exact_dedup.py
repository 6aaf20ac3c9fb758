"""Exact dedup against a dictionary of texts."""

import hashlib
from collections import Counter, defaultdict

from notelake.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out[doc_id, keep, len(ids), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def check(df, rows):
    got = ed.annotate(df, carry=False).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_equals_brute_force(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_edges_carry_their_columns(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(edge_docs, rows)
    out = ed.annotate(edge_docs)
    assert sorted(out.columns) == sorted({*edge_docs.columns, "keep_id", "group_size", "kept", "text_sha256"})
    assert ed.annotate(no_docs).count() == 0
    stay = ed.distinct_documents(edge_docs)
    assert stay.schema == edge_docs.schema
    assert stay.count() == len({text or "" for _, text in rows})


def test_hot_group_and_full_filter(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    got = ed.annotate(df, carry=False, max_bits=1 << 16)  # a filter far too small only flags more rows
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == brute(rows)


def test_unique_rows_are_not_flagged(spark):
    df = spark.range(5000).selectExpr("sha2(cast(id as string), 256) as digest")
    bits = ed.filter_bits(5000)
    flagged = ed.flagged(df, ed.repeated_positions(df, bits), bits).filter("maybe").count()
    assert flagged < 50
    both = df.union(df.limit(100))
    assert ed.flagged(both, ed.repeated_positions(both, bits), bits).filter("maybe").count() >= 200
