"""One-to-one matching of truth and detections, and the metrics built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators.timeline import range_join
from notelake.session import checkpointed


def serial_choice(
    edges: DataFrame, chooser: Sequence[str], option: Sequence[str], turn: Sequence[str], taste: Sequence[Column]
) -> DataFrame:
    """Choosers, in order of ``turn``, each take their best free option by ``taste`` (lowest first).

    Going through choosers one by one gives the only stable matching when every option prefers the earlier
    chooser, so it is found by rounds over all edges at once: everyone asks for the best option left, an option
    keeps the earliest who asks, and all later claims on it are void. No group of conflicting notes is ever
    collected; the loop ends when no two ask for the same option.
    """
    chooser, option = list(chooser), list(option)
    edges = checkpointed(edges)
    best_first = Window.partitionBy(*chooser).orderBy(*taste, *option)
    claims = Window.partitionBy(*option)
    turn_of = F.struct(*turn)
    while True:
        asked = edges.withColumn("_top", F.row_number().over(best_first) == 1)
        asked = asked.withColumn("_held", F.min(F.when(F.col("_top"), turn_of)).over(claims))
        asked = asked.withColumn("_lost", F.coalesce(turn_of > F.col("_held"), F.lit(False)))
        asked = checkpointed(asked)
        if asked.filter("_top and _lost").isEmpty():
            return asked.filter("_top").drop("_top", "_held", "_lost")
        edges = asked.filter("not _lost").drop("_top", "_held", "_lost")


def truth_pairs(
    truth: DataFrame, detected: DataFrame, onset_us: int = 50_000, iou: float = 0.3, keys: Sequence[str] = ("track_id",), carry: Sequence[str] = ()
) -> DataFrame:
    """Pairs of equal pitch, onset within ``onset_us`` and overlap over union of at least ``iou``, with the columns ``carry`` of the detection."""
    t = truth.select(*keys, "midi", "truth_id", F.col("start_us").alias("t_start"), (F.col("start_us") + F.col("dur_us")).alias("t_end"))
    d = detected.select(*keys, "midi", "note_id", *carry, F.col("start_us").alias("d_start"), (F.col("start_us") + F.col("dur_us")).alias("d_end"))
    pairs = range_join(t, d, "t_start", "d_start", onset_us, onset_us, [*keys, "midi"])
    common = F.greatest(F.lit(0), F.least("t_end", "d_end") - F.greatest("t_start", "d_start"))
    union = F.greatest("t_end", "d_end") - F.least("t_start", "d_start")
    return pairs.filter((union > 0) & (common >= iou * union) if iou > 0 else F.lit(True))


def match_truth(
    truth: DataFrame, detected: DataFrame, onset_us: int = 50_000, iou: float = 0.3, keys: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Truth notes in time order take the nearest free detection of the same pitch."""
    return _nearest_free(truth_pairs(truth, detected, onset_us, iou, keys), keys).select(
        *keys, "midi", "truth_id", "note_id", (F.col("d_start") - F.col("t_start")).alias("onset_error_us"),
        (F.col("d_end") - F.col("t_end")).alias("offset_error_us"),
    )


def _nearest_free(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    taste = [F.abs(F.col("d_start") - F.col("t_start")), F.col("d_start")]
    return serial_choice(pairs, [*keys, "truth_id"], [*keys, "note_id"], ["t_start", "truth_id"], taste)


def match_truth_by_detection(
    truth: DataFrame, detected: DataFrame, within_us: int = 100_000, semitones: int = 2, keys: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Detections in time order take the nearest free truth note within two semitones; cents cut to whole numbers."""
    t = truth.select(*keys, "truth_id", F.col("midi").alias("t_midi"), F.col("start_us").alias("t_start"))
    d = detected.select(*keys, "note_id", F.col("midi").alias("d_midi"), F.col("start_us").alias("d_start"))
    pairs = range_join(d, t, "d_start", "t_start", within_us, within_us, keys)
    pairs = pairs.filter(F.abs(F.col("t_midi") - F.col("d_midi")) <= semitones)
    taste = [F.abs(F.col("d_start") - F.col("t_start")), F.col("t_start")]
    got = serial_choice(pairs, [*keys, "note_id"], [*keys, "truth_id"], ["d_start", "note_id"], taste)
    return got.select(*keys, "note_id", "truth_id", ((F.col("d_midi") - F.col("t_midi")) * 100).alias("cents_error"),
                      (F.col("d_start") - F.col("t_start")).alias("time_error_us"))


def unmatched(rows: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(matches, list(keys), "left_anti")


def note_metrics(truth: DataFrame, detected: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, precision, recall, F1 and absolute errors (ms) per ``keys``; deviations are over the population."""
    keys = list(keys)
    onset = F.abs(F.col("onset_error_us")) / 1000.0
    n_truth = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    n_det = detected.groupBy(*keys).agg(F.count("*").alias("n_det"))
    hits = matches.groupBy(*keys).agg(
        F.count("*").alias("tp"), F.avg(onset).alias("mean_onset_ms"), F.stddev_pop(onset).alias("std_onset_ms"),
        F.avg(F.abs(F.col("offset_error_us")) / 1000.0).alias("mean_offset_ms"),
    )
    rows = n_truth.join(n_det, keys, "full").join(hits, keys, "left").na.fill(
        0, ["n_truth", "n_det", "tp", "mean_onset_ms", "std_onset_ms", "mean_offset_ms"]
    )
    p = F.when(F.col("n_det") > 0, F.col("tp") / F.col("n_det")).otherwise(0.0)
    r = F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(0.0)
    return rows.withColumn("fp", F.col("n_det") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp")).withColumn(
        "p", p).withColumn("r", r).withColumn(
        "f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def leaderboard(results: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Mean and deviation of P/R/F1 over cases, overall P/R from summed counts, error means over results above 0."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return results.groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg("r").alias("mean_r"),
        F.stddev_pop("r").alias("std_r"), F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("overall_p"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("overall_r"),
        F.coalesce(F.avg(F.when(F.col("mean_onset_ms") > 0, F.col("mean_onset_ms"))), F.lit(0.0)).alias("mean_onset_ms"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
    )


def leaderboard_by_category(results: DataFrame) -> DataFrame:
    """Mean F1 by (category, method), by category and overall, with the best method of each category."""
    cube = results.rollup("category", "method").agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("n"),
                                                    F.grouping_id().alias("level"))
    best = results.groupBy("category", "method").agg(F.avg("f1").alias("f")).groupBy("category").agg(
        F.min_by("method", F.struct(-F.col("f"), F.col("method"))).alias("best_method"))
    return cube.join(best, "category", "left")


def sweep_best(truth: DataFrame, detected: DataFrame, thresholds: Sequence[float], onset_us: int = 50_000) -> DataFrame:
    """F1 of every (method, confidence threshold) over all tracks, the best marked; first of equals wins.

    The grid is a fixed handful of thresholds. Notes meet once, whatever the method and threshold; only the pairs near each other are
    copied, once per threshold the detection passes, and the truth is only counted for the grid.
    """
    cuts = F.array(*[F.lit(float(c)) for c in thresholds])
    passed = F.explode(F.filter(cuts, lambda c: c <= F.col("confidence")))
    methods = detected.select("method").distinct().filter("method is not null")
    n_truth = truth.agg(F.count("*").alias("n_truth")).filter("n_truth > 0")
    grid = methods.join(F.broadcast(n_truth)).withColumn("cut", F.explode(cuts)).groupBy("method", "cut").agg(F.sum("n_truth").alias("n_truth"))
    keys = ["track_id", "method", "cut"]
    near = truth_pairs(truth, detected, onset_us, 0.0, carry=["method", "confidence"]).filter("method is not null")
    near = near.select("track_id", "method", passed.alias("cut"), "truth_id", "note_id", "t_start", "d_start")
    hits = _nearest_free(near, keys).groupBy("method", "cut").agg(F.count("*").alias("tp"))
    n_det = detected.groupBy("method", "confidence").agg(F.count("*").alias("n")).withColumn("cut", passed).groupBy("method", "cut").agg(F.sum("n").alias("n_det"))
    out = grid.join(n_det, ["method", "cut"], "left").join(hits, ["method", "cut"], "left").na.fill(0)
    out = out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_det") + F.col("n_truth"))).otherwise(0.0))
    # the grid has (methods x thresholds) rows, so one partition for the ranking is fine
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), "method", "cut"))
    return out.withColumn("is_best", rank == 1)
