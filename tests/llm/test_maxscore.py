"""Top-k search against full scoring."""

import math
import random

import duckdb
import numpy as np

from notelake.llm import maxscore


def brute(rows, k, every, scale=256.0):
    good = [(i, [math.floor(scale * v) for v in x]) for i, x in rows
            if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, x in {(i, tuple(x)) for i, x in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, maxscore.nearest(df, k, every).collect())) == brute(rows, k, every)


def test_given_vectors(spark):
    check(spark, duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall())


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)]  # many ties
    rows += [(0, None), (1, [1.0, None, 0.0]), (2, [float("nan"), 1.0, 1.0]), (3, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(50, [1.0, 1.0]), (10, [1.0]), (11, []), (20, [0.0, 0.0, 0.0]), rows[0], rows[7], (-50, [0.1, 0.2, 0.3])]
    check(spark, rows, 5, 10)
    check(spark, [(0, [1.0]), (50, [2.0])])
    check(spark, [])


def test_pruning_keeps_the_best_of_any_shard():
    rng = np.random.default_rng(2)
    for n in (1, 4, 30, 600):
        shard = np.floor(rng.standard_t(2, (n, 24)) * 20)
        ids = rng.permutation(n).astype(np.int64)
        for _ in range(20):
            query = np.floor(rng.standard_t(2, 24) * 20)
            want = sorted(((-int(s), int(i)) for s, i in zip(shard @ query, ids, strict=True) if i != 2))[:5]
            assert maxscore.top_k(ids, shard, 2, query, 5) == [(-s, i) for s, i in want]


def test_shards_and_queries_meet_without_joins_or_broadcasts(spark, monkeypatch):
    """Blocks of queries used to be copied once per shard and broadcast, which the driver had to hold."""
    for name, value in (("SHARD", 16), ("QUERIES", 4), ("HELD", 4000), ("GROUPS", 6)):
        monkeypatch.setattr(maxscore, name, value, raising=False)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([12, 12, 12, 7]))]) for i in range(700)]
    rows += rows[::60] + [(5, None), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = maxscore.nearest(df, 5, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 10)


def test_best_rise_from_shard_to_shard():
    rng = np.random.default_rng(4)
    for largest, width in ((3, 8), (200, 40), (60_000, 16)):  # many ties; single floats; doubles
        vectors = rng.integers(-largest, largest + 1, (3000, width)).astype(np.float64)
        vectors[1000:1400] = vectors[17]
        ids = rng.permutation(3000) // 2  # every id twice
        queries, query_ids = vectors[:600], ids[:600]
        best = maxscore.Best(600, 5)
        for a in range(0, 3000, 500):
            maxscore.meet(ids[a:a + 500], vectors[a:a + 500], query_ids, queries, best)
        for j in range(0, 600, 7):
            want = sorted((-int(s), int(i)) for s, i in zip(vectors @ queries[j], ids, strict=True) if i != query_ids[j])[:5]
            assert [(-int(s), int(i)) for s, i in zip(best.score[j], best.ids[j], strict=True)] == want
