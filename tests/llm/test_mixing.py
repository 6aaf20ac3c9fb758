"""Targets against water filling by hand, the flight's invariants, and whole mixes."""

import random
import re
from collections import Counter, defaultdict

import pytest

from notelake.llm import mixing


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    total = share * sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed = {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        if not open_:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[i] for i in open_)
        over = [i for i in open_ if weight[i] * level > most * sizes[i]]
        if not over:
            return fixed | {i: weight[i] * level for i in open_}
        fixed |= {i: most * sizes[i] for i in over}


def test_targets(spark):
    sizes = {"b": 10, "a": 700, "": 5, "é": 300, "Z": 0, None: 90, "z": 400}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    assert [got[k].nr for k in order] == list(range(len(order)))
    want = targets_by_hand([sizes[k] for k in order])
    for i, k in enumerate(order):
        assert got[k].target == pytest.approx(want[i])


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        chances = [rng.random() for _ in range(n)]
        sizes = [rng.choice([0, 1, 5, 5, 80, 3000]) for _ in range(n)]
        moved = list(chances)
        mixing.flight(moved, sizes, "seed")
        assert sum(0 < p < 1 for p in moved) <= 2
        assert sum(moved) == pytest.approx(sum(chances))
        assert sum(p * s for p, s in zip(moved, sizes, strict=True)) == pytest.approx(sum(p * s for p, s in zip(chances, sizes, strict=True)), abs=1e-4)


def test_inclusion_probabilities_hold_on_average():
    hits = Counter()
    for seed in range(3000):
        chances = [0.2, 0.5, 0.7, 0.9, 0.4]
        mixing.flight(chances, [3, 1, 4, 1, 5], str(seed))
        for i, p in enumerate(chances):
            hits[i] += p
    for i, p in enumerate([0.2, 0.5, 0.7, 0.9, 0.4]):
        assert hits[i] / 3000 == pytest.approx(p, abs=0.03)


def check(df, rows, **options):
    got = mixing.mix(mixing.sized(df), **options).collect()
    words = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(words)
    by = defaultdict(list)
    for r in got:
        assert r.taken == r.size * r.times <= 2 * r.size
        by[r.source].append(r)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) + 1
    return Counter((r.doc_id, r.source, r.size, r.times) for r in got)


def test_whole_mix_near_targets_and_reruns_agree(spark, documents):
    rows = [(d["doc_id"], d["text"], d["source"]) for d in documents]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = check(df, rows)
    assert first == check(df.repartition(7), rows)
    check(df, rows, per_slice=8)  # three levels of slices


def test_edges(edge_docs, no_docs):
    check(edge_docs, [(r.doc_id, r.text, r.source) for r in edge_docs.collect()])
    assert mixing.mix(mixing.sized(no_docs)).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mixed_documents_repeat_rows(edge_docs):
    times = Counter()
    for r in mixing.mix(mixing.sized(edge_docs)).collect():
        times[r.doc_id, r.source] += r.times
    out = mixing.mixed_documents(edge_docs)
    assert out.schema == edge_docs.schema
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +times
