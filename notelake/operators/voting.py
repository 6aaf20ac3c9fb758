"""Candidates of several detectors into consensus notes and onsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dims import ONSET_WEIGHTS, method_weight
from notelake.operators.timeline import SLICE_US, TRACK, Run, group_anchored, group_gap, interval_groups, running
from notelake.session import checkpointed

HOP_US = 23_220


def vote_onsets(
    onsets: DataFrame, tol: int = 30_000, min_votes: int = 2, weights: Mapping[str, float] | None = None, width: int = SLICE_US
) -> DataFrame:
    """Onset candidates (t_us, strength, method, is_legato) voted per anchored group; an attack always passes."""
    table = dict(weights or ONSET_WEIGHTS)
    rows = group_anchored(onsets, tol, width=width).withColumn("w", method_weight(F.col("method"), table))
    attack = F.col("method") == "attack"
    groups = rows.groupBy("track_id", "anchor_t").agg(
        (F.sum(F.col("w") * F.col("t_us")) / F.sum("w")).alias("t_us"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.bool_or(attack).alias("has_attack"), F.bool_or("is_legato").alias("any_legato"),
        F.coalesce(F.max(F.when(attack, F.col("strength"))), F.lit(0.0)).alias("attack_strength"),
    )
    votes = F.size("methods") + F.when(F.col("has_attack"), 0.5).otherwise(0.0)
    return groups.filter((votes >= min_votes) | F.col("has_attack")).select(
        "track_id", "anchor_t", "t_us", F.least(F.lit(1.0), votes / len(table)).alias("confidence"),
        (F.col("any_legato") & ~F.col("has_attack")).alias("is_legato"), "methods", "attack_strength",
    )


def pitch_clusters(
    candidates: DataFrame, tol_us: int = 30_000, tol_cents: float = 50.0, weights: Mapping[str, float] | None = None,
    width: int = SLICE_US,
) -> DataFrame:
    """Per anchored group and pitch, mergeable sums and the pitch (``base_midi``) the row is counted under.

    Going up, a pitch takes in the one a semitone above when their mean frequencies are close, and each pitch is
    used once: inside a run of close neighbours the 2nd, 4th, ... belong to the one below.
    """
    w = method_weight(F.col("method"), weights) * F.col("confidence")
    rows = group_anchored(candidates, tol_us, width=width).withColumn("w", w)
    sums = rows.groupBy("track_id", "anchor_t", "midi").agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("midi")).alias("sw_midi"),
        F.sum(F.col("w") * F.col("frequency")).alias("sw_freq"), F.sum(F.col("w") * F.col("confidence")).alias("sw_conf"),
        F.avg("frequency").alias("mean_freq"), F.min("frequency").alias("min_freq"), F.max("frequency").alias("max_freq"),
        F.min("t_us").alias("min_t"), F.max("t_us").alias("max_t"), F.collect_set("method").alias("methods"),
    )
    # at most one row per pitch here, so a window over a group sees no more than the 128 MIDI numbers
    group = Window.partitionBy("track_id", "anchor_t").orderBy("midi")
    near = F.abs(1200 * F.log2(F.col("mean_freq") / F.lag("mean_freq").over(group))) <= tol_cents
    linked = F.coalesce((F.col("midi") - F.lag("midi").over(group) == 1) & near, F.lit(False))
    sums = sums.withColumn("linked", linked).withColumn("pos", F.row_number().over(group))
    run_at = F.last(F.when(~F.col("linked"), F.col("pos")), True).over(group)
    taken = F.pmod(F.col("pos") - run_at, F.lit(2)) == 1
    return sums.withColumn("base_midi", F.when(taken, F.col("midi") - 1).otherwise(F.col("midi"))).drop("linked", "pos")


def consensus(
    clusters: DataFrame, min_votes: int = 2, min_score: float = 1.5, hop_us: int = HOP_US
) -> DataFrame:
    """Votes, weighted pitch and confidence per cluster."""
    merged = clusters.groupBy("track_id", "anchor_t", "base_midi").agg(
        *[F.sum(c).alias(c) for c in ("n", "sw", "sw_midi", "sw_freq", "sw_conf")],
        F.min("min_freq").alias("min_freq"), F.max("max_freq").alias("max_freq"), F.min("min_t").alias("start_us"),
        (F.max("max_t") + hop_us).alias("end_us"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
    ).withColumn("votes", F.size("methods"))
    kept = merged.filter(
        (F.col("votes") >= min_votes) & (F.col("sw") / F.col("n") >= F.lit(min_score) / F.col("votes")) & (F.col("sw") >= 1e-10)
    )
    boost = 1 + (F.col("votes") - min_votes) * 0.1
    return kept.select(
        "track_id", "anchor_t", "base_midi", F.bround(F.col("sw_midi") / F.col("sw")).cast("int").alias("midi"),
        "start_us", "end_us", (F.col("sw_freq") / F.col("sw")).alias("frequency"),
        F.least(F.lit(1.0), F.col("sw_conf") / F.col("sw") * boost).alias("confidence"), "votes", "methods",
        F.when((F.col("n") > 1) & (F.col("min_freq") > 0), 1200 * F.log2(F.col("max_freq") / F.col("min_freq")))
        .otherwise(0.0).alias("pitch_spread"),
    )


def merge_consensus(rows: DataFrame, gap_us: int = 30_000, width: int = SLICE_US) -> DataFrame:
    """Same-pitch consensus notes that touch become one; confidence and frequency are vote-weighted means."""
    keys = ["track_id", "midi"]
    rows = rows.withColumn("cid", F.col("anchor_t") * 128 + F.col("base_midi")).drop("anchor_t", "base_midi")
    rows = interval_groups(rows, "start_us", "end_us", "cid", gap_us, keys, width)
    v = F.sum("votes")
    return rows.groupBy(*keys, "grp_t", "grp_id").agg(
        F.max("end_us").alias("end_us"), (F.sum(F.col("confidence") * F.col("votes")) / v).alias("confidence"),
        (F.sum(F.col("frequency") * F.col("votes")) / v).alias("frequency"), F.max("votes").alias("votes"),
        F.max("pitch_spread").alias("pitch_spread"), F.count("*").alias("n_merged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
    ).select("track_id", "midi", F.col("grp_t").alias("start_us"), "end_us", "confidence", "frequency", "votes",
             "pitch_spread", "n_merged", "methods")


def ensemble_notes(
    candidates: DataFrame, tol_us: int = 30_000, tol_cents: float = 50.0, min_votes: int = 2, min_score: float = 1.5,
    min_conf: float = 0.5, min_dur_us: int = 50_000, weights: Mapping[str, float] | None = None, width: int = SLICE_US,
) -> DataFrame:
    """Candidates of all detectors to final notes: group, cluster, vote, merge, filter."""
    voted = consensus(pitch_clusters(candidates, tol_us, tol_cents, weights, width), min_votes, min_score)
    # voted rows are a small part of the candidates, and the merge looks at them several times
    merged = merge_consensus(checkpointed(voted), tol_us, width)
    return merged.filter((F.col("confidence") >= min_conf) & (F.col("end_us") - F.col("start_us") >= min_dur_us))


def vote_frames(
    candidates: DataFrame, detectors: Sequence[str], weights: Mapping[str, float], min_votes: int = 2, tol: int = 1
) -> DataFrame:
    """Per frame, detectors in fixed order join the first group within ``tol`` semitones; the best supported group wins.

    One row per detector and frame is expected, so a frame never holds more than ``len(detectors)`` candidates.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in detectors]), F.col("method")).cast("int")
    w = method_weight(F.col("method"), weights) * F.col("confidence")
    rows = candidates.withColumn("ord", order).filter("ord > 0").withColumn("w", w)
    per = rows.groupBy("track_id", "frame").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.col("midi").cast("int").alias("midi"), "frequency", "confidence", "w"))).alias("cs")
    )
    # the midi numbers that opened a group, in order of opening
    heads = (
        "aggregate(cs, cast(array() as array<int>), (acc, c) -> "
        f"if(exists(acc, m -> abs(c.midi - m) <= {tol}), acc, concat(acc, array(c.midi))))"
    )
    per = per.withColumn("heads", F.expr(heads))
    tagged = per.select(
        "track_id", "frame",
        F.expr(f"inline(transform(cs, c -> struct(c, array_position(transform(heads, m -> abs(c.midi - m) <= {tol}), true) as g)))"),
        "heads",
    )
    groups = tagged.groupBy("track_id", "frame", "g").agg(
        F.first(F.expr("element_at(heads, cast(g as int))")).alias("midi"), F.count("*").alias("votes"),
        F.sum("c.w").alias("sw"), F.sum(F.col("c.w") * F.col("c.frequency")).alias("swf"),
        F.avg("c.confidence").alias("confidence"), F.max("c.confidence").alias("max_conf"),
    )
    score = F.when(F.col("votes") >= min_votes, F.col("votes") + F.col("sw") * 0.5)
    lone = F.when(F.col("max_conf") >= 0.7, 0.0)
    groups = groups.withColumn("score", F.coalesce(score, lone)).filter("score is not null")
    best = F.max_by(F.struct("midi", "votes", "sw", "swf", "confidence"), F.struct("score", -F.col("g"))).alias("b")
    return groups.groupBy("track_id", "frame").agg(best).select(
        "track_id", "frame", "b.midi", (F.col("b.swf") / (F.col("b.sw") + 1e-10)).alias("frequency"), "b.confidence", "b.votes"
    )


def attack_consensus(estimates: DataFrame, keys: Sequence[str], lead: str = "hps") -> DataFrame:
    """Largest group of equal pitch among methods (one estimate each; ``ord`` is the order the methods ran in).

    Where the ``lead`` method says a pitch an octave below a group at least as large, its lower pitch wins.
    """
    keys = list(keys)
    groups = estimates.groupBy(*keys, "midi").agg(
        F.count("*").alias("n"), F.min("ord").alias("ord"), F.avg("frequency").alias("frequency"),
        F.bool_or(F.col("method") == lead).alias("leads"),
    )
    g = Window.partitionBy(*keys)  # one row per pitch: at most 128 rows
    groups = groups.withColumn("total", F.sum("n").over(g)).withColumn("lead_midi", F.max(F.when(F.col("leads"), F.col("midi"))).over(g))
    groups = groups.withColumn("lead_n", F.max(F.when(F.col("leads"), F.col("n"))).over(g))
    swap = F.max((F.col("midi") - F.col("lead_midi") == 12) & (F.col("n") >= F.col("lead_n"))).over(g)
    groups = groups.withColumn("swap", F.coalesce(swap, F.lit(False)))
    rank = F.struct((F.col("swap") & F.col("leads")).cast("int"), F.col("n"), -F.col("ord"))
    return groups.groupBy(*keys).agg(F.max_by(F.struct("midi", "frequency", "n", "total"), rank).alias("b")).select(
        *keys, "b.midi", "b.frequency", F.col("b.n").alias("votes"),
        (F.lit(0.3) + 0.7 * F.col("b.n") / F.col("b.total")).alias("confidence"),
    )


def bin_consensus(notes: DataFrame, cell_us: int = 50_000) -> DataFrame:
    """Notes of several runs keyed by (pitch, time cell): means, and confidence raised per extra run."""
    rows = notes.withColumn("cell", F.floor(F.col("start_us") / cell_us).cast("bigint"))
    return rows.groupBy("track_id", "midi", "cell").agg(
        F.count("*").alias("n"), F.avg("start_us").alias("start_us"), F.avg(F.col("start_us") + F.col("dur_us")).alias("end_us"),
        F.avg("confidence").alias("c"), F.avg("frequency").alias("frequency"), F.max("level").alias("level"),
    ).select("track_id", "midi", "cell", "n", "start_us", "end_us", "frequency", "level",
             F.least(F.lit(1.0), F.col("c") * (1 + 0.2 * (F.col("n") - 1))).alias("confidence"))


def detector_stats(candidates: DataFrame) -> DataFrame:
    """Per track and method: counts, share with a pitch, frequency range, mean confidence, rate, and mean length where ``dur_us`` is given."""
    extra = [F.avg("dur_us").alias("mean_dur_us")] if "dur_us" in candidates.columns else []
    return candidates.groupBy("track_id", "method").agg(
        *extra, F.avg((F.coalesce(F.col("frequency"), F.lit(0.0)) > 0).cast("double")).alias("voiced"),
        F.count("*").alias("n"), F.min("frequency").alias("min_hz"), F.max("frequency").alias("max_hz"),
        F.avg("frequency").alias("mean_hz"), F.avg("confidence").alias("mean_conf"),
        F.try_divide(F.count("*"), (F.max("t_us") - F.min("t_us")) / 1e6).alias("rate"),
    )


def method_sets(notes: DataFrame, a: str, b: str) -> DataFrame:
    """Pitches of each track found by both methods, or by one of them only."""
    def of(m: str) -> DataFrame:
        return notes.filter(F.col("method") == m).select(*TRACK, "midi").distinct()

    both = of(a).intersect(of(b)).withColumn("side", F.lit("both"))
    only_a = of(a).exceptAll(of(b)).withColumn("side", F.lit(a))
    only_b = of(b).exceptAll(of(a)).withColumn("side", F.lit(b))
    return both.unionByName(only_a).unionByName(only_b)


def merge_frame_candidates(candidates: DataFrame, tol: float = 1.0) -> DataFrame:
    """Voiced candidates of a frame in groups within ``tol`` semitones of the group's lowest: confidence-weighted pitch.

    A frame holds one candidate per detector, so its list is short.
    """
    per = candidates.groupBy("track_id", "frame").agg(
        F.array_sort(F.collect_list(F.struct(F.col("midi").cast("double").alias("m"), "method", "frequency", "confidence"))).alias("cs"))
    heads = (
        "aggregate(cs, cast(array() as array<double>), (acc, c) -> "
        f"if(size(acc) > 0 and abs(c.m - element_at(acc, -1)) <= {tol}, acc, concat(acc, array(c.m))))"
    )
    rows = per.withColumn("heads", F.expr(heads))
    rows = rows.select("track_id", "frame", F.expr("inline(transform(cs, c -> struct(c, size(filter(heads, h -> h <= c.m)) as g)))"))
    w = F.sum("c.confidence")
    return rows.groupBy("track_id", "frame", "g").agg(
        F.count("*").alias("n"), (F.sum(F.col("c.frequency") * F.col("c.confidence")) / w).alias("frequency"),
        (F.sum(F.col("c.m") * F.col("c.confidence")) / w).alias("midi"), F.max("c.confidence").alias("confidence"))


def combine_contours(contours: DataFrame, weights: Mapping[str, float] | None = None, width: int = SLICE_US) -> DataFrame:
    """(track_id, method, t_us, pitch, confidence) of several models resampled to the longest one's times and averaged.

    Between its own points a model is read off the straight line, outside them its end values hold.
    """
    keys = ["track_id", "method"]
    stats = contours.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    longest = stats.groupBy("track_id").agg(F.min_by("method", F.struct(-F.col("n"), F.col("method"))).alias("method"))
    times = contours.join(longest, keys, "left_semi").select("track_id", "t_us")
    asked = times.join(stats.select(*keys), "track_id").select(*keys, "t_us", F.lit(1).alias("side"), F.lit(None).cast("double").alias("pitch"), F.lit(None).cast("double").alias("confidence"))
    rows = asked.unionByName(contours.select(*keys, "t_us", F.lit(0).alias("side"), "pitch", "confidence"))
    point = F.when(F.col("side") == 0, F.struct("t_us", "pitch", "confidence"))
    rows = running(rows, ["t_us", "side"], width, keys, a=Run("last", point), b=Run("last", point, inclusive=False, reverse=True)).filter("side = 1")
    t = (F.col("t_us") - F.col("a.t_us")) / (F.col("b.t_us") - F.col("a.t_us"))
    line = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(
        F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t)
    rows = rows.select(*keys, "t_us", line("pitch").alias("p"), line("confidence").alias("q")).join(stats, keys)
    w = method_weight(F.col("method"), weights or {"-": 1.0}) * F.col("c")
    return rows.groupBy("track_id", "t_us").agg(
        (F.sum(F.col("p") * w * F.col("q")) / (F.sum(F.col("q") * w) + 1e-8)).alias("pitch"), (F.sum(F.col("q") * w) / F.sum(w)).alias("confidence"))


# Base weight of each analysis resolution, and its factor in fast and slow passages.
RESOLUTION_WEIGHTS = {"ultra_fast": 1.2, "fast": 1.0, "medium": 0.9, "slow": 0.8}
FAST_FACTORS = {"ultra_fast": 1.5, "fast": 1.5, "medium": 0.8, "slow": 0.5}
SLOW_FACTORS = {"ultra_fast": 0.7, "fast": 0.7, "medium": 1.2, "slow": 1.5}


def fuse_resolutions(
    pitches: DataFrame, density: DataFrame, tol_us: int = 30_000, min_dur_us: int = 30_000, min_conf: float = 0.3, width: int = SLICE_US
) -> DataFrame:
    """Pitches of several resolutions to notes: each is weighted by the density class of its time, groups by gap vote
    one pitch, and equal pitches in a row are one note.

    ``pitches``: (track_id, cand_id, t_us, midi, confidence, resolution); ``density``: (track_id, t_us, is_fast, is_slow),
    read at the first entry not before a pitch, or the last one. A note's confidence halves the past at each step, as
    ``c = (c + next) / 2`` does, written as a weighted sum by position.
    """
    kind = F.struct("is_fast", "is_slow")
    marks = density.select("track_id", "t_us", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("cand_id"), kind.alias("kind"))
    # at equal times the entry comes after the pitch, so "next entry" includes it
    rows = pitches.select("track_id", "t_us", F.lit(0).alias("side"), "cand_id", F.lit(None).cast("struct<is_fast: boolean, is_slow: boolean>").alias("kind"), "midi", "confidence", "resolution")
    rows = rows.unionByName(marks, allowMissingColumns=True)
    rows = running(rows, ["t_us", "side", "cand_id"], width, after=Run("last", F.col("kind"), False, True), before=Run("last", F.col("kind"), False))
    rows = rows.filter("side = 0").withColumn("at", F.coalesce("after", "before")).drop("after", "before", "kind", "side")
    base = method_weight(F.col("resolution"), RESOLUTION_WEIGHTS)
    fast = method_weight(F.col("resolution"), FAST_FACTORS | {"-": 0.5})
    slow = method_weight(F.col("resolution"), SLOW_FACTORS | {"-": 0.7})
    w = base * F.when(F.col("at.is_fast"), fast).when(F.col("at.is_slow"), slow).otherwise(1.0)
    rows = group_gap(rows.withColumn("w", w).select("track_id", "t_us", "cand_id", "midi", "confidence", "w"), tol_us, "t_us", "cand_id", width)
    keys = ["track_id", "grp_t", "grp_id"]
    votes = rows.groupBy(*keys, "midi").agg(
        F.sum(F.col("w") * F.col("confidence")).alias("vote"), F.avg("confidence").alias("c"), F.min(F.struct("t_us", "cand_id")).alias("seen"),
        F.sum("t_us").alias("t"), F.count("*").alias("n"))
    # votes are compared to 9 places, then the pitch heard first wins
    group = votes.groupBy(*keys).agg(
        F.min_by(F.struct("midi", "c"), F.struct(-F.round("vote", 9), F.col("seen"))).alias("b"), (F.sum("t") / F.sum("n")).alias("t_us"))
    line = group.select("track_id", "grp_t", "grp_id", "t_us", "b.midi", "b.c")
    line = running(line, ["grp_t", "grp_id"], width, prev=Run("last", F.struct("midi"), False), pos=Run("sum", F.lit(1).cast("bigint")))
    change = F.col("prev").isNull() | (F.col("prev.midi") != F.col("midi"))
    line = running(line, ["grp_t", "grp_id"], width, drop=["prev"], head=Run("last", F.when(change, F.col("pos"))))
    notes = line.groupBy("track_id", "head").agg(F.max("pos").alias("last"))
    line = line.join(notes, ["track_id", "head"])
    share = F.pow(F.lit(0.5), F.col("last") - F.col("pos") + F.when(F.col("pos") == F.col("head"), 0).otherwise(1))
    out = line.groupBy("track_id", "head").agg(
        F.first("midi").alias("midi"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.sum(F.col("c") * share).alias("confidence"), F.count("*").alias("n"))
    return out.filter((F.col("end_us") - F.col("start_us") >= min_dur_us) & (F.col("confidence") >= min_conf)).drop("head")
