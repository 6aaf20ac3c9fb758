"""SuperMinHash against the sequential algorithm, and groups against all pairs of small tables."""

import random
from collections import Counter

import numpy as np
import pytest

from notelake.llm import near_dedup as nd


def brute(rows, words=4, percent=80):
    sets = []
    for _, text in rows:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            raw = raw.replace(c, " ")
        t = [w for w in raw.split(" ") if w]
        sets.append({tuple(t)} if 0 < len(t) < words else {tuple(t[i:i + words]) for i in range(len(t) - words + 1)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), low.get(find(i))) for i, (doc_id, _) in enumerate(rows))


def check(spark, rows, words=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = nd.near_groups(df, words).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def variants(rng, base, n, share):
    return [" ".join(w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def test_signature_equals_the_sequential_walk():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 300)]
    size = 16
    got = nd.superminhash(sets, size)
    for s, signature in zip(sets, got, strict=True):
        want = [np.inf] * size
        for e in s:
            p = list(range(size))
            for j in range(size):
                bits = int(nd.scramble(np.array([int(e) + ((j + 1) * int(nd._MIX[0]) & (2**64 - 1)) & (2**64 - 1)], np.uint64))[0])
                k = j + ((bits >> 32) * (size - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j + (bits & 0xFFFFFFFF) * 2.0**-32)
        assert signature.tolist() == want


def test_signature_estimates_the_similarity_with_less_variance():
    rng = np.random.default_rng(2)
    got = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 130).astype(np.uint64))[:125]
        a, b = nd.superminhash([np.sort(pool[:100]), np.sort(pool[25:125])])
        got.append((a == b).mean())
    assert np.mean(got) == pytest.approx(0.6, abs=0.02)
    assert np.std(got) < np.sqrt(0.6 * 0.4 / nd.SIZE) * 1.1


def test_small_tables_equal_all_pairs(spark, documents):
    check(spark, [(d["doc_id"], d["text"]) for d in documents])


def test_near_copies_chains_and_shared_passages(spark):
    rng = random.Random(3)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    rows = list(enumerate(variants(rng, base, 60, 0.02) + variants(rng, base, 40, 0.06)))  # some pairs hold, others do not
    chain, text = [], list(base)
    for _ in range(30):  # neighbours are alike, the ends are not
        text = list(text)
        text[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        chain.append(" ".join(text))
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) for _ in range(90)]
    for text in chain + shared + ["TWO words", "two WORDS", "two", "", None, " \n\t", "A b c d", "a\tb\nc  D", "  one"]:
        rows.append((len(rows), text))
    rows += [(None, rows[0][1]), (5, rows[5][1]), (None, "nothing like it"), (-4, rows[2][1])]
    check(spark, rows)


def test_groups_at_the_threshold(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    few = [" ".join(w if rng.random() > 0.06 else rng.choice("xyz") for w in base) for _ in range(60)]  # changes that copies share
    check(spark, list(enumerate(few + variants(rng, base, 40, 0.05))), words=5)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(spark, rows)
    assert nd.near_groups(no_docs).count() == 0
    out = nd.distinct_documents(edge_docs)
    assert out.schema == edge_docs.schema
    assert nd.distinct_documents(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(3000, 3001), (3001, 3000)]
    key = lambda i: i.to_bytes(4, "big")
    rows = [(bytearray(key(a)), bytearray(key(b))) for a, b in random.Random(5).sample(path, len(path))]
    links = spark.createDataFrame(rows, "a binary, b binary").repartition(40)
    got = {int.from_bytes(r.id, "big"): int.from_bytes(r.label, "big") for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {3000: 3000, 3001: 3000}


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"b{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, other), (None, "a" + other.replace("o", "q")), (None, "a" + other.replace("o", "q") + " y"),
            (7, "alone"), (7, "lonely too"), (None, None), (None, ""), (3, None), (9, base + " z")]
    kept = Counter(tuple(r) for r in nd.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert sum(kept[r] for r in rows[3:5]) == 1
    assert kept - Counter(rows[3:5]) == Counter([rows[0], rows[2], *rows[5:10]])
