"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Edits Keep (0), Rerole to user or assistant (1), Delete (2; a must for blank
and repeated rows) and Insert an empty turn of user or assistant (5) lead there; a truncated row that stays adds 5. The cheapest edits are sought, and of
equal ones those whose initials in order are ASCII-least.

The state is what was said last: nothing, system, user, assistant. The backward vector of a place holds the cost of the rest from each
state. Vectors are kept at checkpoints only. Inside a slice of ``SLICE`` rows they stand every square root of its rows, and walking
forward recomputes one block at a time. A conversation longer than a slice has its slices' borders as outer checkpoints: a slice is
summed up as a 4 x 4 table of costs, the tables of a conversation give its border vectors, and then each slice
tells where it leads from every set of states. So no task holds more of a conversation than a slice, plus one short row per slice.

The walk keeps the set of all states that the same initials lead to, as rerolling to user and to assistant look alike; which role a turn gets
follows from its place and the final number of turns, as a valid sequence of a given length is unique.

Rows that agree in conversation, turn, role and text are one row with a number of copies: all but the first must go. Rows are sorted by
key ranges, so one conversation with a third of all rows spreads over many slices. Only a conversation's digest and its audit, values of the whole
conversation by nature, are formed in one task, which streams through its rows and holds none of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import small_batches, stored

SLICE_BITS = 12
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing said yet, system, user, assistant said last; the user or assistant turn that may follow leads to:
FOLLOWS = (2, 2, 3, 2)
NEVER = 1 << 40
#: Cost of ending in each state, closing turns inserted.
FINAL = (0, 2 * INSERT, INSERT, 0)
BLANK = "\x20\t\n\x0b\x0c\r"
#: How a row is classed: must go, initial s, u or a, any other initial; truncated rows add TRUNCATED.
GONE, OTHER, TRUNCATED = 0, 4, 8
KEY = ["_c", "turn", "role", "sha"]


def _said(state: int, kind: int) -> int | None:
    """The state after keeping a row of that kind (1 s, 2 u, 3 a), or None where it does not fit."""
    if kind == 1:
        return 1 if state == 0 else None
    return kind if kind in (2, 3) and FOLLOWS[state] == kind else None


def _close(v: list[int]) -> tuple[int, ...]:
    """The vector with turns inserted first where that is cheaper; two suffice to reach any state that can be reached."""
    for _ in range(2):
        v = [min(v[s], INSERT + v[FOLLOWS[s]]) for s in range(4)]
    return tuple(v)


def _row_costs(cls: int, after: tuple[int, ...]) -> list[int]:
    """Cost of the rest from each state before a row, nothing inserted before it, without its further copies."""
    if cls == GONE:
        return [DELETE + c for c in after]
    kind, extra = cls & 7, CUT_OFF if cls & TRUNCATED else 0
    out = []
    for s in range(4):
        best = min(DELETE + after[s], REROLE + extra + after[FOLLOWS[s]])
        to = _said(s, kind)
        out.append(best if to is None else min(best, KEEP + extra + after[to]))
    return out


def checkpoints(classes: list[int], after: tuple[int, ...]) -> tuple[int, list[tuple[int, ...]]]:
    """(block length, backward vectors at the end of each block); the vector before the first row comes from the first block."""
    step = max(1, math.isqrt(len(classes)))
    ends = list(range(step, len(classes), step)) + [len(classes)]
    kept, v = {len(classes): after}, after
    for i in range(len(classes) - 1, -1, -1):
        v = _close(_row_costs(classes[i], v))
        if i % step == 0:
            kept[i] = v
    return step, [kept[e] for e in ends]


def costs_through(classes: list[int]) -> list[int]:
    """The 4 x 4 table (state before, state after) of the cheapest way through a slice; copies' deletions are left out, all ways share them."""
    table = [[NEVER] * 4 for _ in range(4)]
    for out in range(4):
        v = tuple(0 if s == out else NEVER for s in range(4))
        for cls in reversed(classes):
            v = _close(_row_costs(cls, v))
        for s in range(4):
            table[s][out] = min(v[s], NEVER)
    return [c for row in table for c in row]


def walk(classes: list[int], copies: list[int], after: tuple[int, ...], states: frozenset[int], last: bool) -> tuple[list[str], str, frozenset[int]]:
    """(edits of each row with the turns inserted before it, edits after the last row, states reached) for the ASCII-least tight edits."""
    edits: list[str] = []
    step, ends = checkpoints(classes, after)
    for block, end in enumerate(ends):
        rows = classes[block * step:(block + 1) * step]
        vectors = [end]  # recomputed from the checkpoint behind the block
        for cls in reversed(rows):
            vectors.append(_close(_row_costs(cls, vectors[-1])))
        vectors.reverse()
        for i, cls in enumerate(rows):
            here, then, text = vectors[i], vectors[i + 1], ""
            kind, extra = cls & 7, CUT_OFF if cls & TRUNCATED else 0
            while True:
                moves = {"D": {s for s in states if DELETE + then[s] == here[s]}, "I": {FOLLOWS[s] for s in states if INSERT + here[FOLLOWS[s]] == here[s]}}
                if cls != GONE:
                    moves["K"] = {t for s in states if (t := _said(s, kind)) is not None and KEEP + extra + then[t] == here[s]}
                    moves["R"] = {FOLLOWS[s] for s in states if REROLE + extra + then[FOLLOWS[s]] == here[s]}
                edit = min(e for e, reached in moves.items() if reached)
                states, text = frozenset(moves[edit]), text + edit
                if edit != "I":
                    break
            edits.append(text + "D" * (copies[block * step + i] - 1))
    closing = ""
    while last and min(FINAL[s] for s in states):
        closing, states = closing + "I", frozenset(FOLLOWS[s] for s in states)
    return edits, closing, states


def _bits(states: frozenset[int]) -> int:
    return sum(1 << s for s in states)


def _states(bits: int) -> frozenset[int]:
    return frozenset(s for s in range(4) if bits >> s & 1)


def _spoken(edits: list[str], closing: str) -> int:
    return sum(len(e) - e.count("D") for e in edits) + len(closing)


def role_at(place: int, total: int) -> str:
    """The role of turn ``place`` (from 0) of a valid conversation of ``total`` turns."""
    place -= total % 2
    return "system" if place < 0 else ("user", "assistant")[place % 2]


def _keyed(turns: DataFrame) -> DataFrame:
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return turns.select("conv_id", key.alias("_c"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))


def _placed(rows: DataFrame) -> DataFrame:
    """One row per distinct row, in order: KEY, copies, cls, fault of the first copy, at (place); 2^SLICE_BITS places are a slice."""
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    groups = rows.select(*KEY, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut_off")).groupBy(*KEY).agg(
        F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off"))
    groups = stored(groups)
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    seen = groups.groupBy("_c", "role", "sha").agg(F.min(turn).alias("first"))
    seen = seen.select(*[F.col(c).alias(f"_{c}") for c in ("_c", "role", "sha")], F.col("first.turn").alias("_turn"), F.lit(True).alias("first"))
    # the turn is part of the key, so a text that one conversation repeats without end is no hot key
    same = [groups[c].eqNullSafe(seen[f"_{c}"]) if c == "turn" else groups[c] == seen[f"_{c}"] for c in KEY]
    on: Column = same[0]
    for c in same[1:]:
        on = on & c
    rows = groups.join(seen, on, "left").drop("__c", "_role", "_sha", "_turn")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut_off"), "truncated")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(OTHER)
    rows = rows.withColumn("fault", fault).withColumn(
        "cls", F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", kind + TRUNCATED).otherwise(kind).cast("int"))
    rows = rows.select(*KEY, "copies", "cls", "fault").repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return stored(rows.withColumn("at", F.monotonically_increasing_id()))


def edits(turns: DataFrame) -> DataFrame:
    """KEY, at, copies, fault, edits, place and total of every distinct row of ``turns`` (conv_id, turn, role, text), see ``_placed`` and ``report``.

    ``edits`` are the initials of the turns inserted before the row, of the row's own edit and of its further copies, ``closing``
    those of turns inserted after a conversation's last row; ``place`` is how many turns stand before, ``total`` how many the repaired conversation has.
    """
    placed = _placed(_keyed(turns))
    part = F.shiftright("at", SLICE_BITS).alias("part")
    slices = stored(placed.groupBy("_c", part).agg(F.array_sort(F.collect_list(F.struct("at", "cls", "copies", "turn", "role", "sha", "fault"))).alias("rows")))  # at most a slice
    long = slices.groupBy("_c").agg(F.count("*").alias("n"), F.max("part").alias("end")).filter("n > 1").select("_c", "end")
    inner = slices.select("_c", "part", F.col("rows.cls").alias("classes"), F.col("rows.copies").alias("copies")).join(long, "_c")
    inner = stored(inner.withColumn("last", F.col("part") == F.col("end")).drop("end"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [costs_through(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["_c", "part", "table"])

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ascending=False)
        after, v = [], np.array(FINAL)
        for table in pdf["table"]:
            after.append(v.tolist())
            v = (np.array(table).reshape(4, 4) + v).min(axis=1)
        return pd.DataFrame({"_c": pdf["_c"], "part": pdf["part"], "after": after})

    tables_of = inner.select("_c", "part", "classes").mapInArrow(tables, "_c string, part long, table array<long>")
    after = tables_of.groupBy("_c").applyInPandas(backward, "_c string, part long, after array<long>")  # one row per slice
    inner = stored(inner.join(after, ["_c", "part"]))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for classes, copies, last, v in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                to.append([])
                rest = _before(classes, v)
                for bits in range(1, 16):
                    least = min(rest[s] for s in _states(bits))
                    tight = frozenset(s for s in _states(bits) if rest[s] == least)
                    found, closing, states = walk(classes, copies, tuple(v), tight, last)
                    to[-1] += [_bits(states), _spoken(found, closing)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(to, pa.list_(pa.int64()))], names=["_c", "part", "leads"])

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        entry, places, bits, place = [], [], 1, 0
        for to in pdf["leads"]:
            entry.append(bits)
            places.append(place)
            bits, place = int(to[2 * bits - 2]), place + int(to[2 * bits - 1])
        return pd.DataFrame({"_c": pdf["_c"], "part": pdf["part"], "entry": entry, "place": places, "total": place})

    leads_of = inner.select("_c", "part", "classes", "copies", "last", "after").mapInArrow(leads, "_c string, part long, leads array<long>")
    entered = leads_of.groupBy("_c").applyInPandas(forward, "_c string, part long, entry int, place long, total long")
    inner = inner.select("_c", "part", "last", "after").join(entered, ["_c", "part"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, rows, last, v, entry, place, total in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                found, closing, _ = walk([r["cls"] for r in rows], [r["copies"] for r in rows], tuple(v or FINAL), _states(entry or 1), last is not False)
                place = place or 0
                total = _spoken(found, closing) if total is None else total
                out = {k: [] for k in ("place", "closing")}
                for i, e in enumerate(found):
                    out["place"].append(place)
                    out["closing"].append(closing if i == len(found) - 1 else "")
                    place += len(e) - e.count("D")
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * n), pa.array([r["turn"] for r in rows], pa.int64()), pa.array([r["role"] for r in rows]), pa.array([r["sha"] for r in rows], pa.binary()),
                     pa.array([r["at"] for r in rows], pa.int64()), pa.array([r["copies"] for r in rows], pa.int64()), pa.array([r["fault"] for r in rows], pa.string()),
                     pa.array(found), pa.array(out["closing"]), pa.array(out["place"], pa.int64()), pa.array([total] * n, pa.int64())],
                    names=["_c", "turn", "role", "sha", "at", "copies", "fault", "edits", "closing", "place", "total"])

    whole = slices.join(inner, ["_c", "part"], "left").select("_c", "rows", "last", "after", "entry", "place", "total")
    return whole.mapInArrow(emit, "_c string, turn long, role string, sha binary, at long, copies long, fault string, edits string, closing string, place long, total long")


def _before(classes: list[int], after: list[int]) -> tuple[int, ...]:
    v = tuple(after)
    for cls in reversed(classes):
        v = _close(_row_costs(cls, v))
    return v


def repaired_rows(turns: DataFrame) -> DataFrame:
    """The rows of ``edits`` with conv_id and text: one shuffle by the whole key brings texts and edits together and drops copies."""
    small_batches(turns.sparkSession)
    rows = _keyed(turns.withColumn("turn", F.col("turn").cast("long")))
    done = stored(edits(turns.withColumn("turn", F.col("turn").cast("long"))))
    names = [c for c in done.columns if c not in KEY]
    none = F.lit(None).cast(done.select(F.struct(*names).alias("e")).schema["e"].dataType)
    both = rows.select(*KEY, "conv_id", "text", none.alias("e")).unionByName(
        done.select(*KEY, F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(None).cast("string").alias("text"), F.struct(*names).alias("e")))
    met = both.groupBy(*KEY).agg(F.max("conv_id").alias("conv_id"), F.max("text").alias("text"), F.max("e").alias("e"))
    return met.select("conv_id", *KEY, "text", *[F.col(f"e.{n}").alias(n) for n in names])


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and edit (Keep, Rerole or Insert by initial).

    Null roles and texts are one space, null conversations one conversation, null turns come first; equal turns are ordered by role and by the
    SHA-256 of the text. A role whose initial is none of s, u, a (an empty one included) fits nowhere. Texts of any length are kept whole. Other columns
    are ignored; an empty table gives an empty result.
    """
    spoken = F.filter(F.split(F.concat("edits", "closing"), ""), lambda e: e.isin("K", "R", "I"))
    each = repaired_rows(turns).select("conv_id", "role", "text", "place", "total", F.posexplode(spoken).alias("i", "edit"))
    place = F.col("place") + F.col("i")
    shifted = place - F.col("total") % 2
    given = F.when(shifted < 0, "system").when(shifted % 2 == 0, "user").otherwise("assistant")
    return each.select(
        "conv_id", place.alias("place"), F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are streamed in order; see ``repaired`` for nulls and ties. ``gaps`` counts the numbers missing between the first and the last turn,
    ``illegal`` neighbours whose initials are not su, ua or au before the repair.
    """
    kind = turns.schema["conv_id"].dataType
    rows = repaired_rows(turns).select("_c", "conv_id", "turn", "role", "text", "copies", "fault", "edits", "closing", "place", "total", "at")
    rows = rows.repartition("_c").sortWithinPartitions("_c", "at").drop("at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def end(s: dict) -> tuple:
            gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
            return (s["id"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            arrays = [pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["c"] != r["_c"]:
                    if now:
                        out.append(end(now))
                    if len(out) >= 1000:
                        yield flush()
                        out = []
                    now = {"c": r["_c"], "id": r["conv_id"], "high": None, "low": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0,
                           "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "initial": None}
                turn, initial, copies = r["turn"], r["role"][:1], r["copies"]
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"], now["turns"] = turn, now["turns"] + 1
                if r["fault"] == "blank":
                    now["blank"] += copies
                else:
                    now["duplicate"] += copies - (r["fault"] != "duplicate")
                    now["truncated"] += r["fault"] == "truncated"
                if now["initial"] is not None:
                    now["illegal"] += now["initial"] + initial not in ("su", "ua", "au")
                now["illegal"] += copies - 1  # copies stand side by side
                now["initial"] = initial
                place = r["place"]
                for e in r["edits"] + r["closing"]:
                    now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e] + (CUT_OFF if e in "KR" and r["fault"] == "truncated" else 0)
                    if e != "D":
                        role = r["role"] if e == "K" else role_at(place, r["total"])
                        text = "" if e == "I" else r["text"]
                        now["sha"].update(f"{chr(10) if place else ''}{role}:{text}".encode())
                        place += 1
                now["audit"].append(r["edits"] + r["closing"])
        if now:
            out.append(end(now))
        if out:
            yield flush()

    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return rows.mapInArrow(stream, schema)
