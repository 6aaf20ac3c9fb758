"""The decoder over candidates and silence, and the smoothing behind it, against plain passes."""

import math
import random

import pytest

from notelake.operators import decode as dec

ROWS = "track_id long, frame long, midi double, frequency double, confidence double, is_voiced boolean"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for track, n in enumerate((150, 40, 1, 7, 3)):
        note = 60
        for frame in range(n):
            note = rng.choice([note] * 8 + [rng.randrange(45, 80)])
            for _ in range(rng.choice([1, 1, 2, 3])):
                midi = note + rng.choice([0, 0, 0, 12, -12]) + rng.uniform(-0.4, 0.4)
                voiced = rng.random() < 0.8
                rows.append((track, frame, rng.choice([midi, midi, None]) if not voiced else midi, 440 * 2 ** ((midi - 69) / 12), rng.choice([0.1, 0.5, 0.9, rng.random()]), voiced))
    return rows


def jump(d):
    d = abs(d)
    return 0.0 if d == 0 else 0.5 if d <= 2 else 1 + 0.2 * (d - 2) if d <= 5 else 2 + 0.3 * (d - 5) if d <= 7 else 3 + 0.5 * (d - 7) if d <= 12 else 6 + d - 12 if d <= 24 else 30.0


def plain(rows):
    out = {}
    for track in {r[0] for r in rows}:
        frames = sorted({r[1] for r in rows if r[0] == track})
        best, back, costs = {}, [], None
        for frame in frames:
            own = {}
            for _, _, midi, _, confidence, voiced in (r for r in rows if r[:2] == (track, frame)):
                state = min(dec.HIGH, max(dec.LOW, round(midi))) if voiced and midi and midi > 0 else 0
                c = -math.log(min(0.99, max(0.01, confidence))) if voiced else 1.0
                own[state] = min(c, own.get(state, c))
            if costs is None:
                costs = {s: round(c * 1e6) for s, c in own.items()}
            else:
                best, now = {}, {}
                for s, c in own.items():
                    step = lambda a, s=s: 0.0 if a == s == 0 else 0.5 if 0 in (a, s) else jump(a - s)
                    now[s], best[s] = min((costs[a] + round((step(a) + c) * 1e6), a) for a in costs)
                costs = now
                back.append(best)
        state = min((c, s) for s, c in costs.items())[1]
        for i in range(len(frames) - 1, -1, -1):
            out[track, frames[i]] = state
            state = back[i - 1][state] if i else state
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_decoder_equals_one_pass(spark, block):
    rows = made(1)
    got = dec.decode_with_silence(spark.createDataFrame(rows, ROWS).repartition(4), block=block).collect()
    assert {(r.track_id, r.frame): r.midi for r in got} == plain(rows)
    assert all(r.is_voiced == (r.midi > 0) for r in got) and any(not r.is_voiced for r in got)
    surest = {}
    for r in rows:
        surest.setdefault(r[:2], []).append(r)
    for r in got:
        near = [x for x in surest[r.track_id, r.frame] if x[5] and abs(x[2] - r.midi) <= 0.5]
        if r.midi and near:
            assert r.confidence == max(x[4] for x in near)


def plain_smooth(path, most=3):
    midi, voiced = [float(m) for m, _ in path], [v for _, v in path]
    i = 0
    while i < len(path):
        j = i
        while j < len(path) and not path[j][1]:
            j += 1
        if 0 < i < j < len(path) and j - i <= most:
            for k in range(i, j):
                midi[k] = midi[i - 1] + (k - i + 1) / (j - i + 1) * (midi[j] - midi[i - 1])
                voiced[k] = True
        i = max(j, i + 1)
    x = [m for m, v in zip(midi, voiced, strict=True) if v]
    n = len(x)
    w = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
    fold = lambda m: m % (2 * n) if m % (2 * n) < n else 2 * n - 1 - m % (2 * n)
    s = [round(sum(a * x[fold(i + k - 4)] for k, a in enumerate(w)) / sum(w), 9) for i in range(n)] if n > 3 else x
    it = iter(s)
    return [(round(next(it)), True) if v else (0, False) for v in voiced]


@pytest.mark.parametrize("width", [6, 4096])
def test_smoothing_behind_the_decoder(spark, width):
    rng = random.Random(2)
    paths = {}
    for track, n in enumerate((200, 30, 3, 2, 8)):
        paths[track] = [(rng.randrange(50, 70), True) if rng.random() < 0.7 else (0, False) for _ in range(n)]
    rows = [(t, i, m, 0.0, 0.5, v) for t, p in paths.items() for i, (m, v) in enumerate(p)]
    df = spark.createDataFrame(rows, "track_id long, frame long, midi int, frequency double, confidence double, is_voiced boolean").repartition(3)
    got = {(r.track_id, r.frame): (r.midi, r.is_voiced) for r in dec.smooth_path(df, width=width).collect()}
    assert got == {(t, i): x for t, p in paths.items() for i, x in enumerate(plain_smooth(p))}
