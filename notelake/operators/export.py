"""Timelines, grids and distributions for display and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beats(tracks: DataFrame, tempo: int, per_bar: int = 4) -> DataFrame:
    """(track_id, dur_us) to one row per beat before the end; microseconds from the exact beat length."""
    beat = 60_000_000 / tempo
    n = F.ceil(F.col("dur_us") / beat).cast("bigint")
    rows = tracks.filter("dur_us > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return rows.select("track_id", F.floor(F.col("k") * beat).cast("bigint").alias("t_us"), (F.col("k") % per_bar + 1).alias("beat"),
                       F.floor(F.col("k") / per_bar + 1).cast("bigint").alias("measure"), (F.col("k") % per_bar == 0).alias("is_downbeat"))


def measures(tracks: DataFrame, tempo: int, per_bar: int = 4) -> DataFrame:
    """Bars to the end of the track; the last one may hold fewer beats."""
    rows = beats(tracks, tempo, per_bar)
    bar = 60_000_000 / tempo * per_bar
    out = rows.groupBy("track_id", "measure").agg(F.min("t_us").alias("start_us"), F.count("*").alias("beats")).join(tracks, "track_id")
    return out.select("track_id", "measure", "start_us", F.least(F.floor(F.col("measure") * bar).cast("bigint"), F.col("dur_us")).alias("end_us"), "beats")


def timeline(notes: DataFrame, chords: DataFrame, beat_rows: DataFrame, measure_rows: DataFrame) -> DataFrame:
    """All events of a track as rows (t_us, prio, type, data); order by (track_id, t_us, prio, ord)."""
    def event(t, kind: str, ord_, **data):
        pairs = [x for k, v in data.items() for x in (F.lit(k), F.col(v).cast("string"))]
        return F.struct(t.cast("bigint").alias("t_us"), F.lit(0 if kind == "measure" else 1).alias("prio"), F.lit(kind).alias("type"),
                        F.col(ord_).cast("bigint").alias("ord"), F.create_map(*pairs).alias("data"))

    def rows(df, *events):
        """All events of a table in one pass; those without a time are left out."""
        return df.select("track_id", F.inline(F.array(*events))).filter("t_us is not null")

    start, end = F.col("start_us"), F.col("start_us") + F.col("dur_us")
    from_notes = rows(
        notes, event(start, "note_on", "note_id", note_id="note_id", string="string", fret="fret", midi="midi"), event(end, "note_off", "note_id", note_id="note_id"),
        event(F.when(F.col("technique").isNotNull(), start), "technique", "note_id", note_id="note_id", technique="technique"))
    from_chords = rows(chords, event(start, "chord_start", "start_us", name="name"), event(end, "chord_end", "start_us", name="name"))
    from_beats = rows(beat_rows, event(F.col("t_us"), "beat", "t_us", beat="beat", measure="measure", downbeat="is_downbeat"))
    from_bars = rows(measure_rows, event(start, "measure", "measure", number="measure", beats="beats"))
    return from_notes.unionByName(from_chords).unionByName(from_beats).unionByName(from_bars)


def tab_grid(tabs: DataFrame, slot_us: int = 125_000, per_line: int = 16) -> DataFrame:
    """Text lines of a tab: (track_id, line, string, cells); a cell shows the last note that starts in its slot."""
    t = tabs.withColumn("slot", F.floor(F.col("start_us") / slot_us).cast("bigint"))
    cells = t.groupBy("track_id", "string", "slot").agg(F.max_by("fret", F.struct("start_us", "note_id")).alias("fret"))
    cells = cells.withColumn("text", F.when(F.col("fret") < 10, F.col("fret").cast("string")).otherwise(F.format_string("(%d)", F.col("fret").cast("int"))))
    cells = cells.withColumn("line", F.floor(F.col("slot") / per_line).cast("bigint")).withColumn("at", (F.col("slot") % per_line).cast("int"))
    filled = cells.groupBy("track_id", "line", "string").agg(F.map_from_entries(F.collect_list(F.struct("at", "text"))).alias("m"))
    size = tabs.groupBy("track_id").agg((F.floor(F.max(F.col("start_us") + F.col("dur_us")) / slot_us) + 1).cast("bigint").alias("slots"))
    lines = size.withColumn("line", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / per_line).cast("bigint"))))
    lines = lines.withColumn("string", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = lines.join(filled, ["track_id", "line", "string"], "left")
    last = F.least(F.lit(per_line), F.col("slots") - F.col("line") * per_line).cast("int") - 1
    text = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("-"))), "")
    return rows.select("track_id", "line", "string", text.alias("cells"))


def note_distribution(notes: DataFrame) -> DataFrame:
    """Counts of pitch classes per track, over the corpus and in total."""
    return notes.withColumn("pc", F.col("midi") % 12).cube("track_id", "pc").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def polyphony_histogram(notes: DataFrame, cell_us: int = 50_000) -> DataFrame:
    """Per track, how many time cells (nearest, halves to even) hold how many notes."""
    cells = notes.groupBy("track_id", F.bround(F.col("start_us") / cell_us).alias("cell")).agg(F.count("*").alias("size"))
    return cells.groupBy("track_id", "size").agg(F.count("*").alias("n"))


def top_notes(notes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` commonest pitches of each track."""
    counts = notes.groupBy("track_id", "midi").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("n"), "midi"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)
