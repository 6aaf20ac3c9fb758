"""Repairs against a plain program over whole conversations that compares all edits as strings; slices of several widths."""

import hashlib
import random
from collections import defaultdict

import pytest

from notelake.llm import repair
from notelake.llm.queries import damaged

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute(turns):
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = (" " if v is None else v for v in (role, text))
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, _, text in rows:
            last = text.rstrip(BLANKS)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                counts[fault] += 1
        # the best (cost, edits, turns) from each state on, from the end
        best = {"": (0, "", ()), "s": (10, "II", ("user:", "assistant:")), "u": (5, "I", ("assistant:",)), "a": (0, "", ())}
        for (_, _, role, _, text), fault in reversed(list(zip(rows, faults, strict=True))):
            step = {}
            for s in best:
                options = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault else 0
                    to = NEXT[s]
                    options.append((best[to][0] + 1 + extra, "R" + best[to][1], (f"{NAMES[to]}:{text}", *best[to][2])))
                    k = role[:1]
                    if k == to or (k == "s" and s == ""):
                        options.append((best[k][0] + extra, "K" + best[k][1], (f"{role}:{text}", *best[k][2])))
                step[s] = min(options)
            for _ in range(2):
                step = {s: min(v, (step[NEXT[s]][0] + 5, "I" + step[NEXT[s]][1], (f"{NAMES[NEXT[s]]}:", *step[NEXT[s]][2]))) for s, v in step.items()}
            best = step
        known = [r[1] for r in rows if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, said = best[""]
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = brute(rows)
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    said = defaultdict(list)
    for r in repair.repaired(df).collect():
        said[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    assert {c: [t for _, t in sorted(v)] for c, v in said.items()} == {c: list(w[-1]) for c, w in want.items() if w[-1]}
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in said.values())


def conversations(seed, n, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, turns)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "speaker"])
            text = rng.choice(["Hello.", "so it goes", "why?", " ", "", None, "x!\n", "long. " * 3, f"own {c} {t}.", f"own {t}", "Hello.", "é。"])
            rows += [(c, rng.choice([t, t, t, t + 3, None]), role, text)] * rng.choice([1, 1, 1, 2, 4])
    return rows


@pytest.mark.parametrize("bits", [1, 12])
def test_equals_a_plain_program(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SLICE_BITS", bits)
    check(spark, conversations(bits, 60, 14) + [(None, 1, "user", "a."), (None, None, None, None)])


def test_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SLICE_BITS", 6)
    check(spark, [(7, t, *r[2:]) for t, r in enumerate(conversations(5, 60, 20))] + [(8, 1, "user", "same")] * 300)


def test_given_conversations_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    check(spark, [tuple(r) for r in df.collect()])
    check(spark, [tuple(r) for r in damaged(df).select("conv_id", "turn", "role", "text").collect()])
    empty = df.filter("conv_id is null")
    assert repair.report(empty).count() == 0 and repair.repaired(empty).count() == 0
    check(spark, [(1, 5, "user", "long text. " * 20_000), (1, 6, "assistant", "x" * 50_000)])
    more = df.selectExpr("*", "'x' as _c", "'y' as sha", "1 as cls", "2 as edits")
    assert sorted(map(tuple, repair.report(more).collect())) == sorted(map(tuple, repair.report(df).collect()))


def test_checkpoints_recompute_the_same_vectors():
    rng = random.Random(3)
    classes = [rng.choice([0, 1, 2, 3, 4, 9, 10, 11, 12]) for _ in range(150)]
    step, ends = repair.checkpoints(classes, repair.FINAL)
    assert step == 12 and len(ends) == 13
    v, all_vectors = repair.FINAL, [repair.FINAL]
    for cls in reversed(classes):
        v = repair._close(repair._row_costs(cls, v))
        all_vectors.append(v)
    all_vectors.reverse()
    assert ends == [all_vectors[min((b + 1) * step, 150)] for b in range(13)]
