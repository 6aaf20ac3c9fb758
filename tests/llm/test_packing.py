"""Best-two-fit on small histograms, and packing against the documents' own ids."""

import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notelake.llm import packing

VOCABULARY = path("byte_bpe_50k.json")


def one_by_one(counts, capacity):
    """The same method bin by bin, without repeating patterns."""
    left = Counter(counts)
    bins = []
    while +left:
        bin_, gap = [], capacity
        while fits := [s for s, n in left.items() if n and s <= gap]:
            left[max(fits)] -= 1
            bin_.append(max(fits))
            gap -= max(fits)
        while gap:
            small = min(bin_)
            pairs = [(a + b, a) for a in left for b in left if a <= b and left[a] > (a == b) and left[b] and small < a + b <= gap + small]
            if not pairs:
                break
            total, a = max(pairs)
            bin_.remove(small)
            left[small] += 1
            for s in (a, total - a):
                left[s] -= 1
                bin_.append(s)
            gap += small - total
        bins.append(tuple(sorted(bin_)))
    return Counter(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_patterns_equal_packing_bin_by_bin(counts):
    bins = packing.best_two_fit(counts, 40)
    used = Counter()
    for pattern, times in bins:
        assert sum(pattern) <= 40
        for size in pattern:
            used[size] += times
    assert used == Counter(counts)
    assert Counter({p: n for p, n in one_by_one(counts, 40).items()}) == sum((Counter({tuple(sorted(p)): n}) for p, n in bins), Counter())


def test_replacement_fits_more_tightly():
    assert packing.best_two_fit({7: 1, 2: 2, 1: 1}, 10)[0][0] == [7, 2, 1]
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]  # 6 + 3 leaves 1, 6 + 2 + 2 none
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_short_documents_replace_too():
    counts = {n: 53 for n in range(100, 171)}
    bins = packing.fewest_bins(counts, 1024)
    assert sum(times for _, times in bins) <= 1.02 * sum(n * size for size, n in counts.items()) / 1024


def check(df, rows, capacity=1024):
    pieces = packing.tokenized_pieces(df, VOCABULARY, capacity, 2).withColumn("crc", F.crc32("ids"))
    got = packing.pack(pieces.drop("ids"), capacity).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want, total = Counter(), 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) % capacity or capacity
        for n, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start:first if n == 0 else start + capacity]
            want[doc_id, n, start, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-total // capacity)


def test_packs_whole_documents_tightly(spark, documents):
    rows = [(d["doc_id"], d["text"]) for d in documents]
    used, bound = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert used <= bound * 1.02 + 1


def test_edges(edge_docs, no_docs):
    check(edge_docs, [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert packing.pack(packing.tokenized_pieces(no_docs, VOCABULARY).drop("ids")).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    pieces = packing.tokenized_pieces(df, VOCABULARY, 64, 2)
    where = packing.pack(pieces.drop("ids"), 64)
    full = packing.sequences(where.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])).collect()
    assert sum(len(r.ids) for r in full) == 4 * sum(r.length for r in where.collect())
    assert all(len(r.ids) <= 256 for r in full)
