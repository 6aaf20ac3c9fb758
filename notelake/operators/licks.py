"""Licks of a library found in note sequences, overlaps resolved, and the corrections they suggest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.operators.sequence import library
from notelake.operators.theory import literal_table
from notelake.operators.timeline import BLOCK_ROWS, SLICE_US, Run, halo, row_index, running
from notelake.session import checkpointed


def _surest(n_steps: list[int]) -> list[np.ndarray]:
    """Per lick a number for each (notes heard, places heard): the higher, the surer the match, earlier licks first among equals."""
    sure = {(i, h, p): (round(h / n * (1 - (1 - p / n) * 0.3), 9), -i) for i, n in enumerate(n_steps) for h in range(n + 1) for p in range(n + 1)}
    place = {v: k for k, v in enumerate(sorted(set(sure.values())))}
    return [np.array([[place[sure[i, h, p]] for p in range(n + 1)] for h in range(n + 1)]) for i, n in enumerate(n_steps)]


def _hear(steps: list[list[int]], threshold: float, off: int, reach: int, undominated: bool):
    """Function from batches of (..., ``ds``: distances of a start's notes to it) to (..., ``size``, ``lick``, ``heard``, ``placed``), a row per match.

    Notes are bits of a number, so a step looks for its note in all starts of a batch at once. ``placed`` are the places of the lick that a note is heard for, as bits.
    """
    wanted = sorted({s + e for one in steps for s in one for e in range(-off, off + 1)})
    order = _surest([len(one) for one in steps]) if undominated else []

    def match(ds: pa.ListArray) -> tuple[np.ndarray, ...]:
        sizes = ds.value_lengths().to_numpy(zero_copy_only=False)
        n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        flat = ds.flatten()
        heard_at = flat.is_valid().to_numpy(zero_copy_only=False)
        bit = np.uint32(1) << (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
        at = {}
        for v in wanted:
            here = heard_at & (flat == v)
            at[v] = np.zeros(n, np.uint32)
            np.bitwise_or.at(at[v], owner[here], bit[here])
        ring = {(s, e): at[s - e] | at[s + e] for one in steps for s in one for e in range(off + 1)}
        near = {s: np.bitwise_or.reduce([ring[s, e] for e in range(off + 1)]) for one in steps for s in one}
        out, top = [], np.full((n, reach + 1), -1)
        for k, one in enumerate(steps):
            window = np.uint32((1 << (len(one) + 2)) - 1)
            free = np.full(n, window)
            for s in one:
                pick = ring[s, 0] & free
                for e in range(1, off + 1):
                    pick = np.where(pick, pick, ring[s, e] & free)
                free ^= pick & (~pick + np.uint32(1))
            heard = np.bitwise_count(free ^ window).astype(np.int64)
            rows = np.flatnonzero(heard / len(one) >= threshold)
            if not len(rows):
                continue
            # each note heard stands for the first place of the lick that it fits
            left, placed, heard = (free ^ window)[rows], np.zeros(len(rows), np.int64), heard[rows]
            for j, s in enumerate(one):
                fits = near[s][rows] & left
                placed |= (fits != 0).astype(np.int64) << j
                left &= ~fits
            size = np.minimum(sizes[rows], len(one) + 2)
            rank = order[k][heard, np.bitwise_count(placed)] if undominated else None
            if undominated:
                top[rows, size] = np.maximum(top[rows, size], rank)
            out.append((rows, size, np.full(len(rows), k), heard, placed, rank))
        if undominated:
            top = np.maximum.accumulate(top, axis=1)
            out = [tuple(c[keep] for c in m[:5]) for m in out for keep in [m[5] == top[m[0], m[1]]]]
        return tuple(np.concatenate([m[c] for m in out]) if out else np.zeros(0, np.int64) for c in range(5))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            # a batch is as many rows as the session says; the matches of 4096 starts go out at once
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                rows, *found = match(part.column(part.num_columns - 1))
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[:-1], *(pa.array(c, pa.int64()) for c in found)], names=[*part.schema.names[:-1], "size", "lick", "heard", "placed"])

    return batches


def lick_matches(
    notes: DataFrame, threshold: float = 0.7, off: int = 1, min_len: int = 4, width: int = SLICE_US, block: int = BLOCK_ROWS,
    within: str | None = None, undominated: bool = False,
) -> DataFrame:
    """Every start and lick where enough of the lick is heard in the notes from there on (its length and two more).

    Each lick note takes the nearest note not yet taken within ``off`` semitones; ``missing`` are the pitches of those that none
    is heard for. ``first``/``last`` are note numbers (``last`` exclusive); licks are short, so a start looks at a fixed number of
    notes. With ``within`` (a column of consecutive notes, such as a phrase) it looks no further than its end, and the column is kept.
    Notes that already carry their number ``rn`` are not numbered again. With ``undominated`` a match is left out if a surer one with the same
    start ends no later; neither the surest match of some notes nor the matches that overlaps are resolved to are among those left out.
    """
    group = [within] if within else []
    licks = [(i, name, steps) for i, (name, steps) in enumerate(library()) if len(steps) >= min_len]
    reach = max(len(steps) for _, _, steps in licks) + 2
    if "rn" not in notes.columns:
        notes = row_index(notes.select("track_id", "note_id", "start_us", "midi", *group), ["start_us", "note_id"], width)
    rows = halo(notes.select("track_id", "midi", "rn", *group), "rn", block, 0, reach - 1)
    ahead = Window.partitionBy("track_id", "_s", *group).orderBy("rn").rowsBetween(0, reach - 1)
    rows = rows.withColumn("ms", F.collect_list("midi").over(ahead)).filter("_own").filter(F.size("ms") >= min_len)
    rows = rows.select("track_id", *group, "rn", "midi", F.expr("transform(ms, m -> cast(m - midi as int))").alias("ds"))
    found = [T.StructField(c, T.LongType()) for c in ("size", "lick", "heard", "placed")]
    rows = rows.mapInArrow(_hear([steps for _, _, steps in licks], threshold, off, reach, undominated), T.StructType([*rows.schema.fields[:-1], *found]))
    rows = rows.withColumn("p", F.get(literal_table("ord name steps", licks), F.col("lick").cast("int")))
    score, n = F.col("heard") / F.size("p.steps"), F.size("p.steps")
    missing = F.expr("transform(filter(sequence(1, size(p.steps)), i -> (shiftright(placed, i - 1) & 1) = 0), i -> midi + p.steps[i - 1])")
    return rows.select(
        "track_id", *group, F.col("rn").alias("first"), (F.col("rn") + F.col("size")).alias("last"), F.col("midi").alias("root"),
        F.col("p.ord").alias("ord"), F.col("p.name").alias("lick"), F.col("p.steps").alias("steps"), score.alias("score"),
        (score * (1 - (1 - F.bit_count("placed") / n) * 0.3)).alias("confidence"), missing.alias("missing"))


def _decide(matches: pd.DataFrame) -> pd.DataFrame:
    """Surest first within the blocks of ``matches``: those in a block that stay (``kept``) and those that hang on what lies beyond its neighbours.

    Besides their own matches blocks hold those that start a few notes outside. What the outermost may meet is not there, so they (not ``seen``) never win.
    """
    track, block, first, last = (matches[c].to_numpy() for c in ("track_id", "_s", "first", "last"))
    place = np.lexsort((first, block, track))
    fresh = np.r_[True, (track[place][1:] != track[place][:-1]) | (block[place][1:] != block[place][:-1])] if len(place) else np.zeros(0, bool)
    group = np.empty(len(place), np.int64)
    group[place] = np.cumsum(fresh) - 1
    # blocks lie one after the other on one line, too far apart to touch
    low, high = np.full(fresh.sum(), np.iinfo(np.int64).max), np.zeros(fresh.sum(), np.int64)
    np.minimum.at(low, group, first)
    np.maximum.at(high, group, last)
    shift = np.cumsum(high - low) - (high - low) - low
    start, size = first + shift[group], last - first
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((-matches["ord"].to_numpy(), -first, matches["sure"].to_numpy()))] = np.arange(len(place))
    kept, gone = matches["kept"].to_numpy().copy(), np.zeros(len(place), bool)
    covered = np.zeros(int((high - low).sum()), bool)

    def notes_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(rows)), size[rows])
        return owner, start[rows][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])

    covered[notes_of(np.flatnonzero(kept))[1]] = True
    while True:
        rows = np.flatnonzero(~kept & ~gone)
        owner, note = notes_of(rows)
        hit = np.zeros(len(rows), bool)
        hit[owner[covered[note]]] = True
        gone[rows[hit]] = True
        alive = ~hit[owner]
        owner, note = owner[alive], note[alive]
        best = np.full(len(covered), -1)
        np.maximum.at(best, note, rank[rows][owner])
        win = ~hit & matches["seen"].to_numpy()[rows]
        win[owner[best[note] > rank[rows][owner]]] = False
        if not win.any():
            break
        kept[rows[win]] = True
        covered[notes_of(rows[win])[1]] = True
    out = matches.assign(kept=kept)
    return out[matches["own"].to_numpy() & ~gone][["track_id", "first", "last", "ord", "sure", "kept"]]


def resolve_overlaps(matches: DataFrame, block: int = BLOCK_ROWS, share: int = 50_000) -> DataFrame:
    """The surest matches that share no note, earlier starts and licks first among equals.

    Going from the surest down equals rounds in which a match that is best at every note it covers stays and voids the others there. A match only meets those
    a few notes away, so blocks of ``block`` notes with their surroundings go through these rounds by themselves, about ``share`` matches in a task; what then still hangs on a chain of
    matches through the neighbours goes in another round over all blocks. In each the surest open match around is settled, so rounds end.
    """
    surer = Window.partitionBy("track_id", "first").orderBy(F.desc("sure"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    matches = matches.withColumn("sure", F.round("confidence", 9)).withColumn("_end", F.min("last").over(surer))
    # of two with the same start the longer one never stays if it is the less sure one
    matches = checkpointed(matches.filter("_end is null or last < _end").drop("_end"))
    keys = ["track_id", "first", "ord"]
    rows = matches.select(*keys, "last", "sure", F.lit(False).alias("kept"))
    schema = T.StructType([rows.schema[c] for c in ("track_id", "first", "last", "ord", "sure", "kept")])
    reach, n = matches.agg(F.max(F.col("last") - F.col("first")), F.count("*")).first()
    is_open = n > 0
    while is_open:
        near = halo(rows, "first", block, 3 * reach, 3 * reach).withColumnRenamed("_own", "own")
        near = near.withColumn("seen", F.col("first").between(F.col("_s") * block - 2 * reach, (F.col("_s") + 1) * block - 1 + 2 * reach))
        near = near.withColumn("_part", F.pmod(F.xxhash64("track_id", "_s"), F.lit(n // share + 1)))
        rows = checkpointed(near.groupBy("_part").applyInPandas(_decide, schema))
        n, is_open = rows.agg(F.count("*"), F.bool_or(~F.col("kept"))).first()
    return matches.drop("sure").join(rows.select(*keys), keys)


def correct_with_licks(notes: DataFrame, matches: DataFrame) -> DataFrame:
    """Notes an exact octave off the lick's note at their place, moved there.

    ``notes`` carry ``rn``, their number in the track, as the matches count it.
    """
    want = matches.select("track_id", F.col("first"), "root", "lick", "confidence", F.posexplode("steps").alias("pos", "step"))
    want = want.select("track_id", (F.col("first") + F.col("pos")).alias("rn"), (F.col("root") + F.col("step")).alias("want"), "lick", "confidence")
    hit = notes.select("track_id", "rn", "note_id", "midi").join(want, ["track_id", "rn"]).filter(F.abs(F.col("midi") - F.col("want")) == 12)
    # past the two spare notes of a match another lick may begin: the surer one decides
    return hit.groupBy("track_id", "note_id", "midi").agg(F.max_by(F.struct("want", "lick"), F.struct("confidence", "lick")).alias("b")).select(
        "track_id", "note_id", "midi", F.col("b.want").alias("new_midi"), F.col("b.lick").alias("lick"))


def lick_annotations(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per match with the time of its first and last note."""
    n = numbered.select("track_id", "rn", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"))
    a = n.select("track_id", F.col("rn").alias("first"), "start_us")
    b = n.select("track_id", (F.col("rn") + 1).alias("last"), "end_us")
    return matches.join(a, ["track_id", "first"]).join(b, ["track_id", "last"]).select("track_id", "lick", "start_us", "end_us", "score", "confidence")


def numbered_phrases(notes: DataFrame, gap_us: int = 150_000, width: int = SLICE_US) -> DataFrame:
    """Notes with their number ``rn`` in the track and ``phrase``, the number of the first note of their phrase.

    A phrase ends where the next note starts more than ``gap_us`` after the end of the note before it.
    """
    end = F.col("start_us") + F.coalesce("dur_us", F.lit(0))
    order = ["start_us", "note_id"]
    rows = running(notes, order, width, rn=Run("sum", F.lit(1).cast("bigint")), _end=Run("last", end, inclusive=False))
    rows = rows.withColumn("rn", (F.col("rn") - 1).cast("bigint"))
    opens = F.col("_end").isNull() | (F.col("start_us") - F.col("_end") > gap_us)
    return running(rows, order, width, drop=["_end"], phrase=Run("last", F.when(opens, F.col("rn"))))


def phrase_licks(
    phrases: DataFrame, threshold: float = 0.7, off: int = 1, min_len: int = 4, least: int = 4, width: int = SLICE_US, block: int = BLOCK_ROWS
) -> DataFrame:
    """The surest lick of every phrase of ``least`` notes and more that holds one; earlier starts and licks first among equals.

    Takes the notes of ``numbered_phrases``. Besides the match there are ``n_notes``, ``start_us`` and ``end_us`` of the phrase.
    Phrases are only aggregated, so one may be as long as a track.
    """
    found = lick_matches(phrases, threshold, off, min_len, width, block, within="phrase", undominated=True)
    rank = F.struct(F.round("confidence", 9), -F.col("first"), -F.col("ord"))
    row = F.struct("first", "last", "root", "ord", "lick", "steps", "score", "confidence", "missing")
    best = found.groupBy("track_id", "phrase").agg(F.max_by(row, rank).alias("m"))
    end = F.col("start_us") + F.coalesce("dur_us", F.lit(0))
    spans = phrases.groupBy("track_id", "phrase").agg(F.count("*").alias("n_notes"), F.min("start_us").alias("start_us"), F.max_by(end, "rn").alias("end_us"))
    return spans.filter(F.col("n_notes") >= least).join(best, ["track_id", "phrase"]).select("track_id", "phrase", "n_notes", "start_us", "end_us", "m.*")


def corrected_phrases(phrases: DataFrame, licks: DataFrame) -> DataFrame:
    """All notes, those an exact octave off the note that their phrase's lick has at their place moved there with 0.9 of their confidence.

    Places count from the start of the phrase. ``lick`` names the lick of a moved note. Only the first notes of a phrase, as many
    as its lick has, are looked up, by their number.
    """
    want = licks.select("track_id", "phrase", "n_notes", "root", "lick", F.posexplode("steps").alias("pos", "step")).filter(F.col("pos") < F.col("n_notes"))
    want = want.select("track_id", (F.col("phrase") + F.col("pos")).alias("rn"), (F.col("root") + F.col("step")).alias("_want"), F.col("lick").alias("_lick"))
    off = F.coalesce(F.abs(F.col("midi") - F.col("_want")) == 12, F.lit(False))
    rows = phrases.join(want, ["track_id", "rn"], "left").withColumn("_off", off)
    return rows.withColumns({
        "midi": F.when(F.col("_off"), F.col("_want")).otherwise(F.col("midi")),
        "confidence": F.when(F.col("_off"), F.col("confidence") * 0.9).otherwise(F.col("confidence")),
        "lick": F.when(F.col("_off"), F.col("_lick"))}).drop("_off", "_want", "_lick")


def lick_coverage(corrected: DataFrame, licks: DataFrame) -> DataFrame:
    """Per track: notes, phrases with a lick, corrections (moved notes, and one for each phrase with missing notes), share of notes in such phrases."""
    notes = corrected.groupBy("track_id").agg(F.count("*").alias("n_notes"), F.count("lick").alias("n_moved"))
    found = licks.groupBy("track_id").agg(
        F.count("*").alias("n_licks"), F.count_if(F.size("missing") > 0).alias("n_lacking"), F.sum("n_notes").alias("n_covered"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return notes.join(found, "track_id", "left").select(
        "track_id", "n_notes", zero("n_licks").alias("n_licks"), (F.col("n_moved") + zero("n_lacking")).alias("n_corrections"),
        (zero("n_covered") / F.col("n_notes")).alias("coverage"))
