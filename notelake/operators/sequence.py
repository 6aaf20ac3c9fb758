"""Shapes of note sequences and comparison with a library of licks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.theory import literal_table
from notelake.operators.timeline import BLOCK_ROWS, SLICE_US, Run, row_halo, running, slice_window

# Licks as (name, direction, semitones from the first note).
LICKS = [
    ("minor_pent_1oct_up", "ascending", [0, 3, 5, 7, 10, 12]),
    ("major_pent_1oct_up", "ascending", [0, 2, 4, 7, 9, 12]),
    ("minor_pent_2oct", "ascending", [0, 3, 5, 7, 10, 12, 15, 17, 19, 22, 24]),
    ("pent_box1_run", "ascending", [0, 3, 5, 7, 10, 12, 15, 17]),
    ("pent_groups_of_4", "ascending", [0, 3, 5, 7, 3, 5, 7, 10, 5, 7, 10, 12]),
    ("pent_triplet_pattern", "ascending", [0, 3, 5, 3, 5, 7, 5, 7, 10, 7, 10, 12]),
    ("blues_box_run", "ascending", [0, 3, 5, 6, 7, 10, 12]),
    ("bb_king_box", "descending", [12, 10, 12, 10, 7, 10, 7, 5, 7, 5, 3, 0]),
    ("blues_turnaround_1", "mixed", [0, 4, 5, 6, 7, 5, 3, 0]),
    ("blues_bend_lick", "mixed", [3, 5, 3, 0, 3, 5, 7]),
    ("srv_double_stop", "mixed", [0, 3, 5, 0, 3, 7, 5, 3, 0]),
    ("minor_blues_run", "mixed", [0, 3, 5, 6, 7, 6, 5, 3, 0]),
    ("hendrix_r_and_b", "mixed", [0, 4, 7, 12, 7, 4, 0]),
    ("sweep_major_5str", "both", [0, 4, 7, 12, 16, 12, 7, 4, 0]),
    ("sweep_minor_5str", "both", [0, 3, 7, 12, 15, 12, 7, 3, 0]),
    ("sweep_major_3str", "both", [0, 4, 7, 12, 7, 4, 0]),
    ("sweep_minor_3str", "both", [0, 3, 7, 12, 7, 3, 0]),
    ("economy_major_arp", "both", [0, 4, 7, 12, 16, 19, 24, 19, 16, 12, 7, 4, 0]),
    ("sweep_dim", "both", [0, 3, 6, 9, 12, 9, 6, 3, 0]),
    ("sweep_maj7", "both", [0, 4, 7, 11, 12, 11, 7, 4, 0]),
    ("sweep_min7", "both", [0, 3, 7, 10, 12, 10, 7, 3, 0]),
    ("3nps_major_asc", "ascending", [0, 2, 4, 5, 7, 9, 11, 12, 14, 16, 17, 19]),
    ("3nps_minor_asc", "ascending", [0, 2, 3, 5, 7, 8, 10, 12, 14, 15, 17, 19]),
    ("gilbert_sixes", "ascending", [0, 2, 4, 2, 4, 5, 4, 5, 7, 5, 7, 9]),
    ("economy_3nps", "ascending", [0, 2, 4, 7, 9, 11, 12, 14, 16]),
    ("chromatic_run_4", "ascending", [0, 1, 2, 3, 4]),
    ("chromatic_approach", "ascending", [-1, 0]),
    ("chromatic_enclosure", "mixed", [-1, 1, 0]),
    ("crossroads_lick", "mixed", [0, 3, 5, 7, 5, 3, 0, -2, 0, 3]),
    ("stairway_arp", "mixed", [0, 7, 12, 16, 12, 7, 0, 4, 7, 12, 7, 4]),
    ("pinch_run", "ascending", [0, 3, 5, 7, 10, 12, 15, 17]),
    ("evh_tapping_basic", "mixed", [0, 7, 12, 0, 7, 12, 0, 7]),
    ("yngwie_dim_run", "ascending", [0, 1, 3, 6, 7, 9, 12, 13, 15]),
]


def library() -> list[tuple[str, list[int]]]:
    """The licks, each ascending one followed by its reverse."""
    out = []
    for name, direction, steps in LICKS:
        out.append((name, steps))
        if direction == "ascending":
            out.append((f"{name}_descending", steps[::-1]))
    return out


def sequence_profile(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shape of each sequence (``keys``; columns ``midi``, ``interval`` to the note before, null at its start; ``rn`` for order).

    One aggregation without collecting a sequence. ``shape`` is the first rule that fits, for three notes and more.
    """
    d, a = F.col("interval"), F.abs(F.col("interval"))
    n = F.count("*")
    every = lambda cond: F.coalesce(F.bool_and(F.when(d.isNotNull(), cond)), F.lit(True))
    shape = (
        F.when(n < 3, None).when(every(d.between(0, 3)), "ascending_scale").when(every(d.between(-3, 0)), "descending_scale")
        .when(every(d == 1), "chromatic_up").when(every(d == -1), "chromatic_down").when(every(a.isin(3, 4, 5)), "arpeggio")
        .when(F.count_if(d == 0) > F.floor(n / 2), "pedal_tone").when(F.count_if(a == 12) > 0, "octave_jump")
    )
    net = F.max_by("midi", "rn") - F.min_by("midi", "rn")
    return rows.groupBy(*keys).agg(
        n.alias("n"), (F.max("midi") - F.min("midi")).alias("range"),
        F.when(net > 0, "ascending").when(net < 0, "descending").otherwise("mixed").alias("direction"),
        F.avg(a).alias("avg_interval"), F.max(a).alias("max_interval"), every(a <= 1).alias("is_chromatic"),
        (F.count_if(a == 12) > 0).alias("has_octave_jump"), every(a.isin(0, 2, 3, 4, 5, 7, 9, 10, 12)).alias("likely_pentatonic"), shape.alias("shape"),
    ).filter("n >= 2")


def run_heads(rows: DataFrame, run: Sequence[str], first: int = 13, width: int = SLICE_US) -> DataFrame:
    """First ``first`` semitone distances from the start of each run, as an array."""
    order = ["start_us", "note_id"]
    rows = running(rows, order, width, rn=Run("sum", F.lit(1).cast("bigint")))
    begin = rows.groupBy(*run).agg(F.min("rn").alias("rn0"))
    head = rows.join(begin, list(run)).filter(F.col("rn") - F.col("rn0") < first)
    return head.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("rn", "midi"))).alias("h")).select(
        *run, F.transform("h.midi", lambda m: (m - F.get("h.midi", F.lit(0))).cast("int")).alias("intervals"))


def similar_patterns(heads: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Licks whose common prefix (three and more) agrees within a semitone in at least ``threshold`` of the places."""
    table = literal_table("ord name steps", [(i, name, steps) for i, (name, steps) in enumerate(library())])
    mine = F.col("intervals")

    def score(p: Column) -> Column:
        n = F.least(F.size(mine), F.size(p["steps"]))
        near = F.filter(F.zip_with(F.slice(mine, 1, n), F.slice(p["steps"], 1, n), lambda a, b: F.abs(a - b) <= 1), lambda x: x)
        return F.when(n >= 3, F.size(near) / n)

    scored = F.transform(table, lambda p: F.struct(p["ord"].alias("ord"), p["name"].alias("pattern"), score(p).alias("score")))
    rows = heads.withColumn("ps", scored)
    return rows.select(*[c for c in heads.columns if c != "intervals"], F.inline("ps")).filter(F.col("score") >= threshold)


def repeated_riffs(
    notes: DataFrame, shortest: int = 3, longest: int = 16, least: int = 2, percent: int = 10, width: int = SLICE_US, block: int = BLOCK_ROWS
) -> DataFrame:
    """Note sequences that come back: (track_id, first, length, n, occurrences), first being the note's position in the track.

    A later sequence that does not overlap the first one counts as an occurrence if its intervals are equal and each of its steps
    takes the same time within ``percent`` (steps of no time in the first one fit any). Of sequences with the same occurrence
    times (to 10 ms) the shortest, then earliest one stays. Sequences meet once, by the intervals of their first ``shortest`` notes and, split further, by the
    time of their first step on a logarithmic scale, so a frequent interval pattern is no single key.
    """
    reach = slice_window(["track_id"], "rn").rowsBetween(0, longest - 1)
    rows = row_halo(notes.select("track_id", "note_id", "start_us", "midi"), ["start_us", "note_id"], 0, longest - 1, width, block=block)
    rows = rows.withColumn("ms", F.collect_list("midi").over(reach)).withColumn("ts", F.collect_list("start_us").over(reach)).filter("_own")
    sizes = rows.groupBy("track_id").agg(F.count("*").alias("n_track"))
    rows = rows.select("track_id", "rn", "start_us", "ms", "ts").join(sizes, "track_id")
    top = F.least(F.lit(longest), F.size("ms"), F.floor(F.col("n_track") / 2).cast("int"))
    rows = rows.withColumn("top", top).filter((F.col("n_track") >= shortest * least) & (F.col("top") >= shortest))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.col("top") - 1), F.slice(c, 2, F.col("top") - 1), lambda a, b: b - a)
    grams = rows.select("track_id", "rn", "start_us", "top", pairs(F.col("ms")).alias("leaps"), pairs(F.col("ts")).alias("steps"))
    grams = grams.withColumn("intervals", F.concat_ws(",", F.slice("leaps", 1, shortest - 1).cast("array<string>")))
    # a first step of no time fits any pace, other paces fit those that the bounds around them fall into
    step, any_pace = F.col("steps")[0], F.lit(-9).cast("bigint")
    bounded = F.col("steps")[0] > 0 if percent < 100 else F.lit(False)
    pace = lambda x: F.floor(F.ln(x) / (4 * math.log(1 + percent / 100)))
    paces = F.when(bounded, F.sequence(pace(step / (1 + percent / 100) * (1 - 1e-9)), pace(step / max(1 - percent / 100, 1e-3) * (1 + 1e-9)))).otherwise(F.array())
    b = grams.select("track_id", "intervals", F.col("rn").alias("b_rn"), F.col("start_us").alias("b_us"), F.col("top").alias("b_top"), F.col("leaps").alias("b_leaps"),
                     F.col("steps").alias("b_steps"), F.explode(F.array_distinct(F.concat(F.array(any_pace), paces.cast("array<bigint>")))).alias("pace"))
    a = grams.withColumn("pace", F.coalesce(F.when(bounded, pace(step)).cast("bigint"), any_pace))
    # sequences that agree do so from their start on: pairs meet once, with the shortest ones, and each agrees up to some length
    fits = F.transform(F.arrays_zip("leaps", "b_leaps", "steps", "b_steps"), lambda x: (x["leaps"] == x["b_leaps"]) & (
        (x["steps"] <= 0) | (F.abs(x["b_steps"] - x["steps"]) * 100 <= x["steps"] * percent)))
    # the copies of b are many more than the size of its files says, so it must not be broadcast
    met = a.join(b.hint("merge"), ["track_id", "intervals", "pace"]).filter(F.col("b_rn") >= F.col("rn") + shortest)
    agree = F.array_position(fits, F.lit(False)).cast("bigint")
    agree = F.least(F.when(agree > 0, agree).otherwise(F.lit(longest)), "top", "b_top", F.col("b_rn") - F.col("rn"))
    hits = met.select("track_id", "rn", "start_us", "b_rn", "b_us", agree.alias("agree")).filter(F.col("agree") >= shortest)
    hits = hits.withColumn("length", F.explode(F.sequence(F.lit(shortest), F.col("agree").cast("int"))))
    found = hits.groupBy("track_id", "rn", "start_us", "length").agg(F.array_sort(F.collect_list(F.struct("b_rn", "b_us"))).alias("later"))
    times = F.concat(F.array("start_us"), F.transform("later", lambda x: x["b_us"]))
    found = found.select("track_id", F.col("rn").alias("first"), "length", F.transform(times, lambda t: F.round(t / 1e6, 2)).alias("occurrences"), (F.size("later") + 1).alias("n"))
    same = Window.partitionBy("track_id", "occurrences").orderBy("length", "first")
    return found.filter(F.col("n") >= least).withColumn("_place", F.row_number().over(same)).filter("_place = 1").select("track_id", "first", "length", "n", "occurrences")
