"""Phrases against plain counting, the double array against a dictionary, and exact scores beyond 64 bits."""

import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import collocations as co


def brute(rows, least, longest=5, first=2000, percent=100):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        piece_text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ",;:!?\n\x0b\x0c\r":
            piece_text = piece_text.replace(c, ".")
        for piece in piece_text.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i:i + n]] = max(inside[p[i:i + n]], a)
        mine = []
        for p, a in cands.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(mine)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def check(spark, rows, least, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = co.collocations(df, least, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, **options)


def made(seed, n, size=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(size)] + ["Été", "a'b", "x\x00y", "日本"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(words[:8] if rng.random() < 0.7 else words) + rng.choice([" "] * 8 + ["\t", ", ", ".", "\n", "  "])
        out.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return out


def test_equals_plain_counting(spark, monkeypatch):
    rows = made(1, 150) + [(None, "en"), ("", None), (" . ", "fr"), ("A a a A a a", "en"), ("only", "xx")]
    check(spark, rows, 5)
    check(spark, rows, 12, first=7, percent=60)
    monkeypatch.setattr(co, "BLOCK", 40)  # several tries a level and several dictionary blocks
    monkeypatch.setattr(co, "WORDS_IN_BLOCK", 9)
    monkeypatch.setattr(co, "CHUNK", 64)
    monkeypatch.setattr(co, "PROPOSED", 50)
    check(spark, rows, 4)


def test_edges(spark, edge_docs, no_docs):
    got = co.collocations(edge_docs.withColumnRenamed("kept", "phrase").withColumnRenamed("row", "n"), 2)
    assert sorted(tuple(r) for r in got.collect()) == brute([(r.text, r.lang) for r in edge_docs.collect()], 2)
    assert co.collocations(no_docs).count() == 0
    check(spark, [("one word", "en")], 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5_000_000), st.integers(1, 300), st.integers(0, 10**6))
def test_double_array_equals_a_dictionary(k, top, n, seed):
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(1, top + 1, (n, k)) if seed % 2 else rng.integers(1, min(top, 12) + 1, (n, k)), axis=0).astype(np.int64)
    trie = co.DoubleArray(rows, -(-int(rows.max()).bit_length() // co.DIGIT_BITS))
    ids = np.concatenate([rows[rng.permutation(len(rows))].ravel(), rng.integers(0, int(rows.max()) + 1, 200)]).astype(np.int32)
    at, found = trie.match(ids, np.arange(len(ids) - k + 1), k)
    known = {tuple(r): i for i, r in enumerate(rows.tolist())}
    want = {i: known[w] for i in range(len(ids) - k + 1) if (w := tuple(ids[i:i + k].tolist())) in known}
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == want


def test_scores_beyond_64_bits(spark):
    wide = "decimal(38, 0)"
    a, n, l, r = 10**12 + 7, 10**15 + 3, 10**13 + 1, 10**13 + 9
    row = spark.range(1).selectExpr(f"cast(1000 as {wide}) * cast({a} as {wide}) * cast({n} as {wide}) div (cast({l} as {wide}) * cast({r} as {wide})) as s").first()
    assert row.s == 1000 * a * n // (l * r)
