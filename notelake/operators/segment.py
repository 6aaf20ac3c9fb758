"""Frames and notes into runs, regions and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.operators.timeline import (
    BLOCK_ROWS, SLICE_US, TRACK, Run, drift_runs, halo, interval_groups, previous, running, slice_window,
)
from notelake.session import checkpointed

HOP_US = 23_220


def mark_groups(
    rows: DataFrame, order: Sequence[str], starts: Column, width: int = SLICE_US, keys: Sequence[str] = TRACK,
    name: str = "grp", drop: Sequence[str] = (),
) -> DataFrame:
    """Name every row by the first row of its group, given the condition that starts a group."""
    mark = F.when(starts, F.struct(*[F.col(c) for c in order]))
    return running(rows, order, width, keys, drop, **{name: Run("last", mark)})


def phrases(notes: DataFrame, gap_us: int = 300_000, min_size: int = 3, width: int = SLICE_US) -> DataFrame:
    """Notes split where the silence after the previous note exceeds ``gap_us``; phrases of ``min_size`` and more."""
    order = ["start_us", "note_id"]
    rows = notes.select("track_id", "note_id", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"))
    rows = running(rows, order, width, prev=previous("end_us"))
    far = F.col("prev").isNull() | (F.col("start_us") - F.col("prev.end_us") > gap_us)
    rows = mark_groups(rows, order, far, width, drop=["prev"])
    return rows.groupBy("track_id", "grp").agg(
        F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")
    ).filter(F.col("n") >= min_size).select("track_id", F.col("grp.note_id").alias("first_id"), "n", "start_us", "end_us")


def frame_runs(
    frames: DataFrame, same: Sequence[str] = (), keys: Sequence[str] = TRACK, width: int = BLOCK_ROWS
) -> DataFrame:
    """Runs of consecutive frames (rows given are the active ones) with equal ``same`` columns; adds ``run_frame``."""
    rows = halo(frames, "frame", width, before=1)
    w = slice_window(keys, "frame")
    go_on = F.col("frame") - F.lag("frame").over(w) == 1
    for c in same:
        go_on = go_on & (F.col(c) == F.lag(c).over(w))
    rows = rows.withColumn("_go", F.coalesce(go_on, F.lit(False))).filter("_own").drop("_own")
    return running(rows, ["frame"], width, keys, drop=["_go"], run_frame=Run("last", F.when(~F.col("_go"), F.col("frame"))))


def frames_to_notes_exact(
    frames: DataFrame, min_frames: int = 1, end_at_next: bool = True, hop_us: int = HOP_US, width: int = BLOCK_ROWS
) -> DataFrame:
    """Equal-pitch voiced runs as notes; the end is the next frame, or the last frame of the run."""
    voiced = frames.filter("is_voiced and midi > 0").select("track_id", "frame", "midi", "t_us", "confidence")
    rows = frame_runs(voiced, ["midi"], width=width)
    return rows.groupBy("track_id", "run_frame", "midi").agg(
        F.min("t_us").alias("start_us"),
        (F.max("t_us") - F.min("t_us") + (hop_us if end_at_next else 0)).alias("dur_us"),
        F.count("*").alias("n_frames"),
        F.avg("confidence").alias("confidence"),
    ).filter(F.col("n_frames") >= min_frames)


def frames_to_notes_drift(
    frames: DataFrame, tol: int = 1, min_dur_us: int = 50_000, width: int = BLOCK_ROWS
) -> DataFrame:
    """Voiced runs whose pitch stays within ``tol`` of the run's first pitch."""
    voiced = frames.filter("is_voiced and midi > 0")
    runs = drift_runs(voiced, tol, width=width)
    return voiced.join(runs, ["track_id", "frame"]).groupBy("track_id", "run_frame").agg(
        F.min_by("midi", "frame").alias("midi"), F.min("t_us").alias("start_us"),
        (F.max("t_us") - F.min("t_us")).alias("dur_us"), F.count("*").alias("n_frames"),
        F.avg("confidence").alias("confidence"),
    ).filter(F.col("dur_us") >= min_dur_us)


def voiced_regions(frames: DataFrame, min_conf: float = 0.3, min_frames: int = 2, width: int = BLOCK_ROWS) -> DataFrame:
    """Contiguous confident frames; the pitch of a region is its exact median."""
    rows = frame_runs(frames.filter((F.col("midi") > 0) & F.col("is_voiced") & (F.col("confidence") > min_conf)), width=width)
    return rows.groupBy("track_id", "run_frame").agg(
        F.percentile("midi", 0.5).alias("pitch"), F.min("t_us").alias("start_us"),
        (F.max("t_us") - F.min("t_us")).alias("dur_us"), F.count("*").alias("n_frames"),
        F.avg("confidence").alias("confidence"),
    ).filter(F.col("n_frames") >= min_frames)


def merge_same_pitch(notes: DataFrame, gap_us: int = 30_000, width: int = SLICE_US) -> DataFrame:
    """Same-pitch notes that overlap or follow within ``gap_us`` become one: end and confidence are the maxima."""
    rows = notes.select("track_id", "midi", "note_id", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"), "confidence")
    keys = ["track_id", "midi"]
    rows = interval_groups(rows, "start_us", "end_us", "note_id", gap_us, keys, width)
    return rows.groupBy(*keys, "grp_t", "grp_id").agg(
        F.max("end_us").alias("end_us"), F.max("confidence").alias("confidence"), F.count("*").alias("n")
    ).select("track_id", "midi", F.col("grp_t").alias("start_us"), F.col("grp_id").alias("note_id"), "end_us",
             "confidence", "n")


def merge_adjacent_same_pitch(notes: DataFrame, gap_us: int = 30_000, width: int = SLICE_US) -> DataFrame:
    """Only rows next to each other in time merge: another pitch in between stops it. Chains use the running end."""
    order = ["start_us", "note_id"]
    rows = notes.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    rows = running(rows, order, width, prev=previous("midi"))
    change = F.col("prev").isNull() | (F.col("prev.midi") != F.col("midi"))
    rows = mark_groups(rows, order, change, width, name="pitch_run")
    keys = ["track_id", "pitch_run"]
    rows = running(rows, order, width, keys, reach=Run("max", F.col("end_us"), inclusive=False))
    apart = F.col("reach").isNull() | (F.col("start_us") - F.col("reach") >= gap_us)
    rows = mark_groups(rows, order, apart, width, keys)
    return rows.groupBy("track_id", "grp").agg(
        F.first("midi").alias("midi"), F.max("end_us").alias("end_us"), F.max("confidence").alias("confidence"),
        F.count("*").alias("n"),
    ).select("track_id", "midi", F.col("grp.start_us").alias("start_us"), F.col("grp.note_id").alias("note_id"), "end_us",
             "confidence", "n")


def merge_consecutive(notes: DataFrame, gap_us: int = 50_000, semitones: int = 1, width: int = SLICE_US) -> DataFrame:
    """A note within ``semitones`` of the *first* of the running note, at most ``gap_us`` after the end of the one before, prolongs it.

    The end is set to that of the last note, even where an earlier one lasts longer; the pitch is the first one's, the confidence the highest. Notes come in order
    of start, pitch and id. Whether a gap parts two notes depends on these two alone, so gaps become gaps in the numbering and the rest is a drift run.
    """
    order = ["start_us", "midi", "note_id"]
    rows = notes.select("track_id", *order, (F.col("start_us") + F.col("dur_us")).alias("end_us"), "confidence")
    rows = running(rows, order, width, prev=previous("end_us"))
    gap = F.coalesce(F.col("start_us") - F.col("prev.end_us") > gap_us, F.lit(False)).cast("bigint")
    rows = checkpointed(running(rows.withColumn("gap", gap), order, width, drop=["prev"], place=Run("sum", 1 + F.col("gap"))))
    runs = drift_runs(rows.select("track_id", F.col("place").alias("frame"), "midi"), semitones)
    rows = rows.join(runs.select("track_id", F.col("frame").alias("place"), "run_frame"), ["track_id", "place"])
    first = lambda c: F.min_by(c, "place").alias(c)
    return rows.groupBy("track_id", "run_frame").agg(
        first("midi"), first("start_us"), first("note_id"), F.max_by("end_us", "place").alias("end_us"), F.max("confidence").alias("confidence"), F.count("*").alias("n")
    ).drop("run_frame")


def label_runs(
    windows: DataFrame, min_dur_us: int, window_us: int, width: int = SLICE_US
) -> DataFrame:
    """Consecutive windows with one label become a section; a section ends where the next begins, short ones go."""
    rows = running(windows, ["t_us"], width, prev=previous("label"))
    change = F.col("prev").isNull() | (F.col("prev.label") != F.col("label"))
    rows = mark_groups(rows, ["t_us"], change, width)
    sections = rows.groupBy("track_id", F.col("grp.t_us").alias("start_us")).agg(
        F.first("label").alias("label"), F.avg("confidence").alias("confidence"), F.max("t_us").alias("last_us")
    )
    sections = running(sections, ["start_us"], 60 * width, next=Run("last", F.col("start_us"), False, True))
    sections = sections.withColumn("end_us", F.coalesce("next", F.col("last_us") + window_us))
    return sections.filter(F.col("end_us") - F.col("start_us") >= min_dur_us).select(
        "track_id", "start_us", "end_us", "label", "confidence"
    )


def merge_overlapping(intervals: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Overlapping intervals (start_us, end_us, id, score, reason) as unions with the best score and joined reasons."""
    rows = interval_groups(intervals, "start_us", "end_us", "id", 0, TRACK, width, touching=False)
    return rows.groupBy("track_id", "grp_t", "grp_id").agg(
        F.max("end_us").alias("end_us"), F.max("score").alias("score"), F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"),
    ).select("track_id", F.col("grp_t").alias("start_us"), "end_us", "score", "n", "reason")


def mark_legato_runs(notes: DataFrame, gap_us: int = 100_000, width: int = SLICE_US) -> DataFrame:
    order = ["start_us", "note_id"]
    rows = notes.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    rows = running(rows, order, width, prev=previous("end_us", "midi"))
    step = F.abs(F.col("midi") - F.col("prev.midi"))
    go_on = (F.col("start_us") - F.col("prev.end_us") < gap_us) & step.between(1, 7)
    rows = rows.withColumn("starts", ~F.coalesce(go_on, F.lit(False)))
    rows = rows.withColumn("interval", F.when(~F.col("starts"), F.col("midi") - F.col("prev.midi")))
    return mark_groups(rows, order, F.col("starts"), width, name="run", drop=["prev"])


def legato_runs(notes: DataFrame, gap_us: int = 100_000, min_notes: int = 4, width: int = SLICE_US) -> DataFrame:
    """Fast connected runs with direction, mean confidence and notes per second."""
    rows = mark_legato_runs(notes, gap_us, width)
    up, down = F.count_if(F.col("interval") > 0), F.count_if(F.col("interval") < 0)
    dur = (F.max_by("end_us", F.struct("start_us", "note_id")) - F.min("start_us")) / 1e6
    return rows.groupBy("track_id", "run").agg(
        F.count("*").alias("n"), F.min("start_us").alias("start_us"),
        F.when(up > down * 2, "ascending").when(down > up * 2, "descending").otherwise("mixed").alias("direction"),
        F.avg("confidence").alias("confidence"),
        F.when(dur > 0, F.count("*") / dur).otherwise(0.0).alias("notes_per_second"),
    ).filter(F.col("n") >= min_notes).select(
        "track_id", F.col("run.note_id").alias("first_id"), "n", "start_us", "direction", "confidence", "notes_per_second"
    )


def three_per_string(notes: DataFrame, gap_us: int = 100_000, min_notes: int = 4, width: int = SLICE_US) -> DataFrame:
    """Per legato run: do groups of three, split at leaps above 3 semitones, make up half the groups?"""
    rows = mark_legato_runs(notes, gap_us, width)
    split = F.col("starts") | (F.abs("interval") > 3)
    rows = mark_groups(rows, ["start_us", "note_id"], split, width, name="part")
    parts = rows.groupBy("track_id", "run", "part").agg(F.count("*").alias("size"))
    runs = parts.groupBy("track_id", "run").agg(
        F.sum("size").alias("n"), F.count_if(F.col("size") == 3).alias("threes"), F.count("*").alias("groups")
    ).filter(F.col("n") >= min_notes)
    yes = (F.col("n") >= 6) & (F.col("threes") >= F.floor(F.col("groups") / 2))
    return runs.select("track_id", F.col("run.note_id").alias("first_id"), "n", "threes", "groups", yes.alias("is_3nps"))


def tremolo_notes(
    notes: DataFrame, gap_us: int = 80_000, max_dur_us: int = 150_000, min_rate: float = 8.0, width: int = SLICE_US, skip: Column | None = None
) -> DataFrame:
    """Notes in rapid repetitions within a semitone of the section's first pitch, with the section's rate.

    Notes under ``skip`` take no part and end a section.
    """
    order = ["start_us", "note_id"]
    rows = notes.select("track_id", "note_id", "start_us", "dur_us", "midi", (F.col("start_us") + F.col("dur_us")).alias("end_us"),
                        (F.lit(False) if skip is None else skip).alias("skip"))
    rows = running(rows, order, width, prev=previous("end_us", "dur_us"), rn=Run("sum", F.lit(1).cast("bigint")))
    cut = (F.col("start_us") - F.col("prev.end_us") > gap_us) | (F.col("prev.dur_us") > max_dur_us)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("bigint")).drop("prev")
    rows = running(rows, order, width, cuts=Run("sum", F.col("cut")))
    # a cut skips one number and a note left out leaves a hole: both read as a gap between frames
    rows = rows.withColumn("frame", F.col("rn") + F.col("cuts")).filter("not skip").drop("rn", "cuts", "cut", "skip")
    rows = checkpointed(rows)  # read three times below
    rows = rows.join(drift_runs(rows, 1), ["track_id", "frame"])
    keys = ["track_id", "run_frame"]
    sections = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("midi", "frame").alias("base_midi"), F.min("start_us").alias("from_us"),
        F.max_by("end_us", "frame").alias("to_us"), F.min_by("note_id", "frame").alias("first_id"))
    sections = sections.filter((F.col("n") >= 3) & (F.col("to_us") > F.col("from_us"))).withColumn(
        "rate", F.col("n") / ((F.col("to_us") - F.col("from_us")) / 1e6)).filter(F.col("rate") >= min_rate)
    return rows.select(*keys, "note_id").join(sections, keys)


def tremolo_sections(
    notes: DataFrame, gap_us: int = 80_000, max_dur_us: int = 150_000, min_rate: float = 8.0, width: int = SLICE_US
) -> DataFrame:
    """One row per tremolo section."""
    rows = tremolo_notes(notes, gap_us, max_dur_us, min_rate, width).filter("note_id = first_id")
    return rows.select("track_id", "first_id", "n", "base_midi", F.col("from_us").alias("start_us"), F.col("to_us").alias("end_us"), "rate",
                       F.least(F.lit(1.0), F.col("rate") / 15).alias("confidence"))


def poly_frames_to_notes(
    presence: DataFrame, track_frames: DataFrame, min_frames: int = 1, hop_us: int = HOP_US, width: int = BLOCK_ROWS
) -> DataFrame:
    """Per pitch, presence in consecutive frames is one note with the confidence of its first frame.

    ``presence``: (track_id, frame, midi, confidence); ``track_frames``: (track_id, n_frames), for notes still on at the end.
    """
    keys = ["track_id", "midi"]
    rows = frame_runs(presence, keys=keys, width=width)
    return rows.groupBy(*keys, "run_frame").agg(
        F.max("frame").alias("last"), F.min_by("confidence", "frame").alias("confidence")
    ).join(track_frames, "track_id").select(
        *keys, (F.col("run_frame") * hop_us).alias("start_us"),
        ((F.least(F.col("last") + 1, F.col("n_frames")) - F.col("run_frame")) * hop_us).alias("dur_us"), "confidence",
    ).filter(F.col("dur_us") >= min_frames * hop_us)


def coalesce_detectors(primary: DataFrame, secondary: DataFrame, low_hz: float = 75.0, high_hz: float = 1400.0) -> DataFrame:
    """Per frame: a confident primary pitch, else an in-range secondary one at 0.5, else the weak primary.

    Frames up to the last one that both detectors have reached count; a hole in the secondary leaves the primary. A track
    without any secondary frame has none in common.
    """
    s = secondary.select("track_id", "frame", F.col("frequency").alias("f2"))
    last = s.groupBy("track_id").agg(F.max("frame").alias("_last"))
    rows = primary.join(s, ["track_id", "frame"], "left").join(last, "track_id").filter(F.col("frame") <= F.col("_last"))
    sure = (F.col("frequency") > 0) & (F.col("confidence") > 0.5)
    fall_back = (F.col("f2") > 0) & F.col("f2").between(low_hz, high_hz)
    weak = F.col("frequency") > 0
    return rows.select(
        "track_id", "frame",
        F.when(sure, F.col("frequency")).when(fall_back, F.col("f2")).when(weak, F.col("frequency")).otherwise(0.0).alias("frequency"),
        F.when(sure, F.col("confidence")).when(fall_back, 0.5).when(weak, F.greatest(F.lit(0.3), F.col("confidence")))
        .otherwise(0.0).alias("confidence"),
    )


def activations_to_notes(
    probs: DataFrame, threshold: float = 0.5, low: int = 40, high: int = 88, hop_us: int = HOP_US, width: int = BLOCK_ROWS
) -> DataFrame:
    """(track_id, frame, midi, p) above the threshold in consecutive frames: one note, confidence = the maximum."""
    keys = ["track_id", "midi"]
    rows = frame_runs(probs.filter((F.col("p") > threshold) & F.col("midi").between(low, high)), keys=keys, width=width)
    return rows.groupBy(*keys, "run_frame").agg(F.count("*").alias("n"), F.max("p").alias("confidence")).select(
        *keys, (F.col("run_frame") * hop_us).alias("start_us"), (F.col("n") * hop_us).alias("dur_us"), "confidence"
    )


def string_head_to_notes(
    heads: DataFrame, threshold: float = 0.5, hop_us: int = HOP_US, longest: int = 50, width: int = BLOCK_ROWS
) -> DataFrame:
    """(track_id, frame, string, onset, fret_class, n_frames, open_midi): an onset lasts to the next one on its string.

    Class 0 is silence: it yields no note but still ends the note before it.
    """
    rows = halo(heads.filter(F.col("onset") > threshold), "frame", width, after=longest)
    nxt = F.lead("frame").over(slice_window(["track_id", "string"], "frame"))
    # without a next onset the note lasts to the track end; never above ``longest`` frames
    stop = F.least(F.coalesce(nxt, F.col("n_frames")), F.col("frame") + longest, F.col("n_frames"))
    return rows.withColumn("stop", stop).filter("_own and fret_class > 0").select(
        "track_id", "string", (F.col("open_midi") + F.col("fret_class") - 1).cast("int").alias("midi"),
        (F.col("frame") * hop_us).alias("start_us"), ((F.col("stop") - F.col("frame")) * hop_us).alias("dur_us"),
        F.col("onset").alias("confidence"),
    )
