"""Result, playback and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.export import timeline


def write_results(results: DataFrame, summary: DataFrame, path: str, run_id: str) -> None:
    """Detailed results and summary of one run, each partitioned by run; a rerun of the same run replaces it."""
    for name, df in (("results", results), ("summary", summary)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def latest_results(spark: SparkSession, path: str, name: str = "summary") -> DataFrame:
    """Rows of the last run. Run ids sort by time; only the partition names are looked at to find it."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    last = rows.select(F.col("run_id").cast("string").alias("run_id")).agg(F.max("run_id").alias("run_id"))
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(F.broadcast(last), "run_id", "left_semi")


def sync_documents(
    tabs: DataFrame, chords: DataFrame, beat_rows: DataFrame, measure_rows: DataFrame, tempo: int, part_us: int | None = None
) -> DataFrame:
    """Playback documents as (track_id, part, document): metadata, notes, chords, beats, measures, events in time order.

    One document holds a whole recording. ``part_us`` cuts long ones into parts of that length instead, so that no
    document holds an unbounded stretch. A track without tabs but with chords, beats or measures has a document without notes.
    """
    s = lambda c, d=3: F.round(F.col(c) / 1e6, d)
    part = lambda c: (F.floor(F.col(c) / part_us) if part_us else F.lit(0)).cast("bigint").alias("part")

    def in_order(xs: Column) -> Column:
        # data of events cannot be compared, so their keys and places are sorted
        keys = F.sort_array(F.transform(xs, lambda x, i: F.struct(x["_t"], x["_o"], i.alias("i"))))
        return F.transform(keys, lambda k: F.get(xs, k["i"]).dropFields("_t", "_o"))

    def pack(df: DataFrame, t: str, tie: str, name: str, *fields) -> DataFrame:
        rows = df.select("track_id", part(t), F.struct(F.col(t).alias("_t"), F.col(tie).cast("bigint").alias("_o"), *fields).alias("x"))
        return rows.groupBy("track_id", "part").agg(F.collect_list("x").alias("xs")).select("track_id", "part", in_order(F.col("xs")).alias(name))

    t = tabs.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    c = chords.withColumn("end_us", F.col("start_us") + F.col("dur_us"))
    notes = pack(t, "start_us", "note_id", "notes", F.col("note_id").alias("id"), s("start_us", 4).alias("start"), s("end_us", 4).alias("end"), "midi", "string", "fret", "technique")
    chord = pack(c, "start_us", "start_us", "chords", s("start_us").alias("start"), s("end_us").alias("end"), "name")
    beat = pack(beat_rows, "t_us", "t_us", "beats", s("t_us", 4).alias("time"), "beat", "measure", "is_downbeat")
    bars = pack(measure_rows, "start_us", "start_us", "measures", s("start_us", 4).alias("start"), s("end_us", 4).alias("end"), F.col("measure").alias("number"), "beats")
    events = pack(timeline(tabs, chords, beat_rows, measure_rows), "t_us", "prio", "events", s("t_us", 4).alias("time"), "type", "data")
    span = t.groupBy("track_id").agg(F.max("end_us").alias("dur"), F.count("*").alias("total_notes"))
    out = notes
    for df in (chord, beat, bars, events):
        out = out.join(df, ["track_id", "part"], "full")
    out = out.join(span, "track_id", "left").fillna(0, ["total_notes"])
    document = F.struct(
        F.lit("1.0").alias("version"),
        F.struct(F.col("track_id"), s("dur").alias("duration"), F.lit(tempo).alias("tempo"), F.lit("4/4").alias("time_signature"), "total_notes",
                 F.round(F.col("total_notes") / (F.col("dur") / 1e6), 2).alias("avg_notes_per_second")).alias("metadata"),
        F.struct("events", "measures", "beats").alias("timeline"),
        F.struct("notes", "chords").alias("tab_data"),
        F.struct(F.col("notes.start").alias("note_starts"), F.col("notes.end").alias("note_ends"), F.col("notes.string").alias("note_strings"),
                 F.col("notes.fret").alias("note_frets"), F.col("beats.time").alias("beat_times")).alias("playback"),
    )
    return out.select("track_id", "part", F.to_json(document).alias("document"))


def write_sync(documents: DataFrame, path: str) -> None:
    """One JSON line per document, in folders by a hash of the track so that no folder grows without bound."""
    documents.withColumn("bucket", F.pmod(F.hash("track_id"), F.lit(64))).select("bucket", F.col("document").alias("value")).write.mode("overwrite").partitionBy(
        "bucket").text(path)


def report_documents(report: DataFrame, passages: DataFrame, sections: DataFrame) -> DataFrame:
    """Difficulty report per track as JSON, which names its track: at most ten passages and seven sections, so a document stays small."""
    r = lambda c, name, d=1: F.round(F.col(c), d).alias(name)
    n = lambda c, name: F.col(c).alias(name)
    span = [F.round(F.col("start_us") / 1e6, 2).alias("start_time"), F.round(F.col("end_us") / 1e6, 2).alias("end_time")]

    def listed(df: DataFrame, order: str, name: str, *fields: str | Column) -> DataFrame:
        xs = F.array_sort(F.collect_list(F.struct(order, *span, *fields)))
        return df.groupBy("track_id").agg(F.transform(xs, lambda x: x.dropFields(order)).alias(name))

    p = listed(passages, "rank", "difficult_passages", "reason", F.round("score", 2).alias("difficulty_score"))
    q = listed(sections, "ord", "practice_sections", "focus", n("level", "difficulty"), F.filter(F.split("tips", ", "), lambda t: t != "").alias("tips"))
    rows = report.join(p, "track_id", "left").join(q, "track_id", "left")
    document = F.struct(
        "track_id", F.col("level").alias("overall_rating"), F.round("score", 1).alias("overall_score"),
        F.struct(n("n", "total_notes"), n("max_span", "max_fret_span"), n("max_fret", "max_fret_used"), r("avg_span", "avg_fret_span", 2), r("max_nps", "max_notes_per_second"),
                 r("avg_nps", "avg_notes_per_second"), n("n_positions", "unique_positions"), "string_changes", n("shifts", "position_changes")).alias("metrics"),
        # harmonics and palm mutes are never counted, as in the method
        F.struct(n("hammer_on", "hammer_ons"), n("pull_off", "pull_offs"), n("bend", "bends"), n("slide", "slides"), "vibrato", n("trill", "trills"), "tremolo",
                 F.lit(0).alias("harmonics"), F.lit(0).alias("palm_mutes")).alias("techniques"),
        F.struct(*[r(f"{x}_rating", x) for x in ("speed", "technique", "stretch", "position")]).alias("sub_ratings"),
        *[F.coalesce(F.col(x), F.array()).alias(x) for x in ("difficult_passages", "practice_sections")])
    return rows.select("track_id", F.to_json(document).alias("document"))


def write_report(documents: DataFrame, path: str) -> None:
    """One JSON line per report."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)
