"""Lick matches found batch by batch and overlaps resolved block by block, against plain loops."""

import random

import pytest

from notelake.operators import licks as lk
from notelake.operators.sequence import library


def plain_matches(midi, threshold, off):
    out = {}
    for a in range(len(midi)):
        for k, (_, steps) in enumerate(library()):
            ds = [m - midi[a] for m in midi[a:a + 15]][:len(steps) + 2]
            if len(steps) < 4 or len(midi[a:a + 15]) < 4:
                continue
            taken = []
            for s in steps:
                near = sorted((abs(d - s), i) for i, d in enumerate(ds) if abs(d - s) <= off and i not in taken)
                taken += [i for _, i in near[:1]]
            if len(taken) / len(steps) >= threshold:
                placed = {next(j for j, s in enumerate(steps) if abs(ds[t] - s) <= off) for t in taken}
                score = len(taken) / len(steps)
                out[a, k] = (a + len(ds), score * (1 - (1 - len(placed) / len(steps)) * 0.3), tuple(midi[a] + s for j, s in enumerate(steps) if j not in placed))
    return out


@pytest.mark.parametrize("threshold,off", [(0.7, 1), (0.5, 2)])
def test_matches_and_resolution_equal_plain_loops(spark, threshold, off):
    rng = random.Random(5)
    tune = [60 + rng.randrange(8) for _ in range(45)]
    df = spark.createDataFrame([(t, 100 * t + i, 1000 * i, m) for t in (1, 2) for i, m in enumerate(tune)], "track_id long, note_id long, start_us long, midi int")
    want = plain_matches(tune, threshold, off)
    found = lk.lick_matches(df, threshold, off, width=7000, block=16)
    got = {(r["track_id"], r["first"], r["ord"]): (r["last"], round(r["confidence"], 9), tuple(r["missing"])) for r in found.collect()}
    assert want and got == {(t, *k): (last, round(c, 9), lacks) for t in (1, 2) for k, (last, c, lacks) in want.items()}

    kept, used = [], set()
    for (a, k), (last, _, _) in sorted(want.items(), key=lambda x: (-round(x[1][1], 9), x[0])):
        if not used & set(range(a, last)):
            used |= set(range(a, last))
            kept.append((a, k))
    few = lk.lick_matches(df, threshold, off, width=7000, block=16, undominated=True)
    assert few.count() < len(got)
    for matches in (found, few):
        for block in (3, 4096):  # 3: chains of matches go through many blocks and need several rounds
            rows = lk.resolve_overlaps(matches, block=block, share=20).collect()
            assert sorted((r["track_id"], r["first"], r["ord"]) for r in rows) == sorted((t, *x) for t in (1, 2) for x in kept)


def test_no_matches(spark):
    df = spark.createDataFrame([(1, i, 1000 * i, 60 + 30 * (i % 2)) for i in range(9)], "track_id long, note_id long, start_us long, midi int")
    assert lk.resolve_overlaps(lk.lick_matches(df, 0.85, undominated=True)).count() == 0
