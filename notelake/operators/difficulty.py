"""Speed, stretch, passages and the difficulty report of tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.positions import hand_position
from notelake.operators.timeline import SLICE_US, TRACK, halo, interval_groups, previous, running
from notelake.session import checkpointed

# Thresholds for notes per second, fret span and number of hand positions.
NPS = (3.0, 6.0, 10.0)
SPAN = (3, 4, 5)
POSITIONS = (3, 5)
TECHNIQUES = ["hammer_on", "pull_off", "bend", "slide", "vibrato", "trill", "tremolo"]
COMPLEXITY = {"bend": 3.0, "trill": 3.0, "vibrato": 2.0, "hammer_on": 1.0, "pull_off": 1.0, "slide": 1.5, "tremolo": 2.0}


def fret_span(tabs: DataFrame, reach_us: int = 500_000, width: int = SLICE_US) -> DataFrame:
    """Widest stretch over fretted notes within ``reach_us`` on either side of each note."""
    rows = halo(tabs, "start_us", width, before=reach_us, after=reach_us)
    near = Window.partitionBy("track_id", "_s").orderBy("start_us").rangeBetween(-reach_us, reach_us)
    fret = F.when(F.col("fret") > 0, F.col("fret"))
    span = F.coalesce(F.max(fret).over(near) - F.min(fret).over(near), F.lit(0))
    return rows.withColumn("span", span).filter("_own").drop("_s", "_own")


def note_steps(tabs: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Notes with their ``span``, hand position ``place`` and ``prev``, the note before: what windows, speed and the report read, shuffled once."""
    string = [c for c in tabs.columns if c == "string"]  # only the report needs it
    rows = fret_span(tabs.select("track_id", "note_id", "start_us", "fret", *string), width=width).withColumn("place", hand_position(F.col("fret")))
    return running(rows, ["start_us", "note_id"], width, prev=previous("start_us", "place", *string))


def hopping(rows: DataFrame, window_us: int, t: str = "start_us") -> DataFrame:
    """Rows copied to the half-overlapping windows (from time 0) that hold them: adds ``win_us``."""
    step = window_us // 2
    low = F.greatest(F.lit(0), F.floor((F.col(t) - window_us) / step).cast("bigint") + 1)
    return rows.withColumn("win_us", F.explode(F.transform(F.sequence(low, F.floor(F.col(t) / step).cast("bigint")), lambda k: k * step)))


def _extent(tabs: DataFrame) -> DataFrame:
    return tabs.groupBy("track_id").agg((F.max("start_us") - F.min("start_us")).alias("total_us"))


def speed(tabs: DataFrame, window_us: int = 1_000_000, min_gap_us: int = 20_000, width: int = SLICE_US, steps: DataFrame | None = None) -> DataFrame:
    """Fastest and mean rate between notes, and the best rate over half-overlapping windows; ``steps``: ``note_steps`` of the tabs, where they are there already."""
    tabs = tabs if steps is None else steps
    rows = running(tabs.select("track_id", "note_id", "start_us"), ["start_us", "note_id"], width, prev=previous("start_us")) if steps is None else steps
    gap = F.col("start_us") - F.col("prev.start_us")
    rate = F.when(gap >= min_gap_us, 1e6 / gap)
    flow = rows.groupBy("track_id").agg(F.max(rate).alias("max_nps"), F.avg(rate).alias("avg_nps"))
    counts = hopping(tabs.select("track_id", "start_us"), window_us).groupBy("track_id", "win_us").agg(F.count("*").alias("n"))
    wins = counts.join(_extent(tabs), "track_id").filter("win_us < total_us")
    length = (F.least(F.col("win_us") + window_us, F.col("total_us")) - F.col("win_us")) / 1e6
    best = wins.groupBy("track_id").agg(F.max(F.col("n") / length).alias("fastest_nps"))
    out = flow.join(best, "track_id", "left")
    none = F.col("max_nps").isNull()  # no gap long enough: everything reads 0
    return out.select("track_id", *[F.when(none, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("max_nps", "avg_nps", "fastest_nps")])


def window_scores(tabs: DataFrame, window_us: int = 2_000_000, width: int = SLICE_US, steps: DataFrame | None = None) -> DataFrame:
    """Windows of 3 notes and more that are hard by speed, stretch or position shifts; ``steps`` as in ``speed``."""
    rows = note_steps(tabs, width) if steps is None else steps
    tabs = tabs if steps is None else steps
    rows = rows.select("track_id", "start_us", "span", F.col("prev.start_us").alias("prev_us"), (F.col("place") != F.col("prev.place")).alias("moved"))
    wins = hopping(rows, window_us).groupBy("track_id", "win_us").agg(
        F.count("*").alias("n"), ((F.max("start_us") - F.min("start_us")) / 1e6).alias("len"), F.max("span").alias("max_span"),
        F.count_if((F.col("prev_us") >= F.col("win_us")) & F.col("moved")).alias("shifts"),
    ).filter("n >= 3").join(_extent(tabs), "track_id").filter("win_us < total_us")
    nps = F.when(F.col("len") > 0, F.col("n") / F.col("len"))
    shown = F.format_string("%.1f notes/sec)", F.bround(nps, 1))
    wins = wins.withColumn("reason", F.concat_ws(
        "; ",
        F.when(nps >= NPS[2], F.concat(F.lit("Fast passage ("), shown)).when(nps >= NPS[1], F.concat(F.lit("Moderate speed ("), shown)),
        F.when(F.col("max_span") >= SPAN[2], F.format_string("Wide stretch (%d frets)", "max_span")),
        F.when(F.col("shifts") >= 3, F.format_string("Multiple position shifts (%d)", "shifts")),
    )).withColumn("score", F.greatest(
        F.when(nps >= NPS[2], F.least(F.lit(1.0), nps / 15)).when(nps >= NPS[1], nps / 15),
        F.when(F.col("max_span") >= SPAN[2], F.least(F.lit(1.0), F.col("max_span") / 7)),
        F.when(F.col("shifts") >= 3, F.least(F.lit(1.0), F.col("shifts") / 5)),
    ))
    return wins.filter("score >= 0.4").select("track_id", F.col("win_us").alias("start_us"), (F.col("win_us") + window_us).alias("end_us"), "n", "score", "reason")


def difficult_passages(windows: DataFrame, top: int = 10, width: int = SLICE_US) -> DataFrame:
    """Overlapping hard windows as passages; the ``top`` hardest per track, earlier first among equals."""
    # hard windows are few: a row or two per second of music at most, read several times below
    rows = interval_groups(checkpointed(windows).withColumn("id", F.lit(0)), "start_us", "end_us", "id", 0, TRACK, width, touching=False)
    passages = rows.groupBy("track_id", "grp_t").agg(F.max("end_us").alias("end_us"), F.max("score").alias("score"), F.count("*").alias("n_windows"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("score"), "grp_t"))
    best = passages.withColumn("rank", rank).filter(F.col("rank") <= top)
    # reasons are put together for the kept passages only
    texts = rows.select("track_id", "grp_t", "start_us", "reason").join(best.select("track_id", "grp_t"), ["track_id", "grp_t"], "left_semi")
    texts = texts.groupBy("track_id", "grp_t").agg(F.array_sort(F.collect_list(F.struct("start_us", "reason"))).alias("rs"))
    return best.join(texts, ["track_id", "grp_t"]).select(
        "track_id", "rank", F.col("grp_t").alias("start_us"), "end_us", "score", "n_windows", F.array_join("rs.reason", "; ").alias("reason"))


def practice_sections(passages: DataFrame, techniques: DataFrame, top: int = 5) -> DataFrame:
    """The hardest passages with tips by reason, and sections for often used techniques."""
    tips = F.concat(
        F.when(F.col("reason").contains("Fast"), F.array(F.lit("slow metronome"), F.lit("raise tempo step by step"))).otherwise(F.array()),
        F.when(F.lower("reason").contains("stretch"), F.array(F.lit("finger stretches"), F.lit("thumb position"))).otherwise(F.array()),
        F.when(F.lower("reason").contains("position"), F.array(F.lit("isolate the shift"), F.lit("guide fingers"))).otherwise(F.array()),
    )
    hard = passages.filter(F.col("rank") <= top).select(
        "track_id", F.col("rank").alias("ord"), "start_us", "end_us", F.trim(F.element_at(F.split("reason", ";"), 1)).alias("focus"),
        F.when(F.col("score") > 0.7, "advanced").otherwise("intermediate").alias("level"), F.array_join(tips, ", ").alias("tips"))

    def section(cond: Column, ord_: int, focus: str, text: str) -> DataFrame:
        return techniques.filter(cond).select("track_id", F.lit(ord_).alias("ord"), F.lit(0).alias("start_us"), F.lit(0).alias("end_us"),
                                              F.lit(focus).alias("focus"), F.lit("intermediate").alias("level"), F.lit(text).alias("tips"))

    bends = section(F.col("bend") > 2, 101, "Bend accuracy practice", "tuner, whole and half steps, vibrato at the peak")
    legato = section(F.col("hammer_on") + F.col("pull_off") > 3, 102, "Legato technique", "hammer strength, quick pull-offs, one string first")
    return hard.unionByName(bends).unionByName(legato)


def technique_stats(annotated: DataFrame) -> DataFrame:
    """Count per technique and the share of notes with one, in percent."""
    counts = [F.count_if(F.col("technique") == t).alias(t) for t in TECHNIQUES]
    used = F.count_if(F.col("technique").isin(TECHNIQUES))
    return annotated.groupBy("track_id").agg(F.count("*").alias("n_notes"), *counts, (used / F.count("*") * 100).alias("density"))


def ladder(x: Column, low: float, mid: float, high: float, over: float) -> Column:
    """Piecewise linear 0-25-50-75, then up to 100 over ``over`` more."""
    return (
        F.when(x <= low, x / low * 25).when(x <= mid, 25 + (x - low) / (mid - low) * 25)
        .when(x <= high, 50 + (x - mid) / (high - mid) * 25).otherwise(F.least(F.lit(100.0), 75 + (x - high) / over * 25))
    )


def difficulty_report(tabs: DataFrame, annotated: DataFrame, width: int = SLICE_US, steps: DataFrame | None = None) -> DataFrame:
    """One row per track: four ratings and the weighted score with its level; ``steps`` as in ``speed``."""
    rows = note_steps(tabs, width) if steps is None else steps
    base = rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.max("fret").alias("max_fret"), F.max("span").alias("max_span"), F.avg("span").alias("avg_span"),
        F.countDistinct("place").alias("n_positions"), F.count_if(F.col("place") != F.col("prev.place")).alias("shifts"),
        F.count_if(F.col("string") != F.col("prev.string")).alias("string_changes"))
    out = base.join(speed(tabs, width=width, steps=steps), "track_id").join(technique_stats(annotated), "track_id")
    rate = ladder(F.greatest("max_nps", "fastest_nps"), *NPS, 5.0)
    complexity = sum((F.col(t) * w for t, w in COMPLEXITY.items()), F.lit(0.0)) / F.greatest("n", F.lit(1)) * 100
    technique = F.least(F.lit(100.0), (F.col("density") * 2 + complexity) / 2)
    stretch = ladder(F.col("max_span"), *SPAN, 3.0) * 0.7 + F.least(F.lit(100.0), F.col("avg_span") / 4 * 50) * 0.3
    p = F.col("n_positions")
    places = F.when(p <= POSITIONS[0], p / POSITIONS[0] * 25).when(
        p <= POSITIONS[1], 25 + (p - POSITIONS[0]) / (POSITIONS[1] - POSITIONS[0]) * 25).otherwise(F.least(F.lit(100.0), 50 + (p - POSITIONS[1]) / 5 * 50))
    position = F.least(F.lit(100.0), F.col("shifts") / F.col("n") * 500) * 0.6 + places * 0.4
    out = out.withColumn("speed_rating", rate).withColumn("technique_rating", technique).withColumn("stretch_rating", stretch).withColumn("position_rating", position)
    score = F.col("speed_rating") * 0.35 + F.col("technique_rating") * 0.25 + F.col("stretch_rating") * 0.20 + F.col("position_rating") * 0.20
    level = F.when(F.col("score") < 25, "beginner").when(F.col("score") < 50, "intermediate").when(F.col("score") < 75, "advanced").otherwise("expert")
    return out.withColumn("score", score).withColumn("level", level)
