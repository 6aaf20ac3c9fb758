"""Streaming, source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notelake.operators import difficulty as dif
from notelake.operators import export as ex
from notelake.operators import positions as pos
from notelake.plans.registry import register
from notelake.plans.segment import NOTE_SLICE
from notelake.plans.tabs import _annotated, _static
from notelake.plans.theory import CHORDS_SQL, _chords
from notelake.plans.voting import NOTES_SQL
from notelake.plans.windows import _BEATS, _extents
from notelake.session import checkpoint_dir, checkpointed
from notelake.sources import adapters as src
from notelake.sources import readers, writers
from notelake.streaming import live


def _live(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = live.file_stream(spark, sf, "events.parquet")
    return rows.selectExpr("user_id as track_id", "event_id as note_id", "ts", "cast(40 + floor(value) % 49 as int) as midi", "1.0D as weight",
                           "cast((1 + event_id % 100) / 100 as double) as confidence", f"{src._method()} as method")


_LIVE = "_n AS (SELECT user_id AS track_id, event_id AS note_id, ts, epoch_us(ts) AS us, 40 + floor(value)::BIGINT % 49 AS midi FROM events)"
register(
    "stream_density",
    lambda spark, sf: live.drain(live.stream_density(_live(spark, sf), "2 days", "1 day", "1 day"), "complete").withColumn("w_start", F.unix_micros("w_start")),
    "track_id w_start n", "",
    _LIVE + """, result AS (SELECT track_id, w AS w_start, count(*) AS n FROM (SELECT track_id, unnest([us // 86400000000 * 86400000000, (us // 86400000000 - 1) * 86400000000]) AS w FROM _n) GROUP BY ALL)""",
)
register(
    "stream_phrases",
    lambda spark, sf: live.drain(live.stream_phrases(_live(spark, sf), "6 hours", "1 day"), "complete").withColumn("w_start", F.unix_micros("w_start")),
    "track_id w_start n low high", "",
    _LIVE + """, _f AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY track_id ORDER BY us) >= 21600000000, true) AS s FROM _n),
    _g AS (SELECT *, sum(s::INT) OVER (PARTITION BY track_id ORDER BY us) AS g FROM _f),
    result AS (SELECT track_id, min(us) AS w_start, count(*) AS n, min(midi) AS low, max(midi) AS high FROM _g GROUP BY track_id, g)""",
)
register(
    "stream_dedupe",
    lambda spark, sf: live.drain(live.stream_dedupe(_live(spark, sf).withColumn("midi", F.expr("midi % 4")), 86_400_000_000, "40 days"), "append").select("track_id", "midi", "slot"),
    "track_id midi slot", "",
    _LIVE + ", result AS (SELECT DISTINCT track_id, midi % 4 AS midi, us // 86400000000 AS slot FROM _n)",
)
register(
    "stream_pitch_histogram",
    lambda spark, sf: live.drain(live.stream_pitch_histogram(_live(spark, sf), "10 days", "1 day"), "complete").select(
        "track_id", F.unix_micros("w_start").alias("w_start"), F.expr("array_join(transform(hist, x -> cast(cast(x as int) as string)), ',')").alias("hist")),
    "track_id w_start hist$", "",
    _LIVE + """, _w AS (SELECT track_id, us // 864000000000 * 864000000000 AS w_start, midi % 12 AS pc FROM _n),
    result AS (SELECT track_id, w_start, """ + " || ',' || ".join(f"count(*) FILTER (pc = {i})" for i in range(12)) + " AS hist FROM _w GROUP BY track_id, w_start)",
)
def _live_consensus(spark, sf):
    """Candidates as a feed that ends; its notes in the time of the candidates."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = src.candidates_of(live.file_stream(spark, sf, "events.parquet"))
    feed = rows.select("track_id", F.timestamp_micros(F.col("t_us") + src.EPOCH_US).alias("ts"), "midi", "confidence", "frequency", "method")
    end = live.EndMark(feed)
    notes = live.drain(live.stream_consensus(end.stream, delay="50 milliseconds"), "append", end.set)
    return notes.withColumns({c: F.col(c) - src.EPOCH_US for c in ("start_us", "end_us")})


register(
    "stream_consensus", _live_consensus,
    "track_id midi start_us end_us confidence~ frequency~ votes pitch_spread~ n_merged", "candidates",
    NOTES_SQL + ", result AS (SELECT * FROM ensemble)", recursive=True,
)


def _cases(spark, sf):
    notes = src.notes(spark, sf)
    name = F.concat(F.lit("case_"), F.col("track_id").cast("string")).alias("case")
    present = notes.groupBy("track_id").agg(F.count("*").alias("n")).filter("n >= 60").select(name)
    return readers.plan_cases(notes.select(name).distinct(), ["pyin", "yin", "cqt"], present)


register(
    "plan_cases", lambda spark, sf: _cases(spark, sf).withColumnRenamed("case", "case_name"), "case_name$ method$", "notes",
    """_c AS (SELECT 'case_' || track_id AS case_name FROM notes GROUP BY track_id HAVING count(*) >= 60), result AS (SELECT case_name, unnest(['pyin', 'yin', 'cqt']) AS method FROM _c)""",
)


def _documents(spark, sf):
    tabs = pos.static_position(src.notes_dense(spark, sf)).withColumn("technique", F.expr("if(note_id % 3 = 0, 'bend', null)"))
    t = _extents(spark, sf)
    chords = checkpointed(_chords(spark, sf))  # read by the documents and by their events
    docs = writers.sync_documents(tabs, chords, ex.beats(t, 480), ex.measures(t, 480), 480)
    path = f"{checkpoint_dir(spark)}/sync-{uuid.uuid4().hex}"
    writers.write_sync(docs, path)
    # one pass over each document; what is only counted stays text
    seen = F.from_json("value", """metadata struct<track_id: bigint>, tab_data struct<notes: array<string>, chords: array<string>>,
        timeline struct<events: array<string>, beats: array<string>, measures: array<string>>, playback struct<note_starts: array<double>>""").alias("d")
    count = lambda p: F.size(f"d.{p}")
    return spark.read.text(path).select(seen).select(
        "d.metadata.track_id", count("tab_data.notes").alias("n_notes"), count("timeline.events").alias("n_events"),
        count("timeline.beats").alias("n_beats"), count("timeline.measures").alias("n_measures"), F.greatest(F.lit(0), F.coalesce(count("tab_data.chords"), F.lit(0))).alias("n_chords"),
        F.get("d.playback.note_starts", F.lit(0)).alias("first_start"))


register(
    "write_sync", _documents, "track_id n_notes n_events n_beats n_measures n_chords first_start~", "notes_dense",
    CHORDS_SQL + "," + _BEATS + """,
    _nn AS (SELECT track_id, count(*) AS n_notes, count(*) FILTER (note_id % 3 = 0) AS n_tech, min(start_us) AS first_us FROM notes_dense GROUP BY ALL),
    _nb AS (SELECT track_id, count(*) AS n_beats FROM bt GROUP BY ALL), _nm AS (SELECT track_id, count(*) AS n_measures FROM ms GROUP BY ALL),
    _nc AS (SELECT track_id, count(*) AS n_chords FROM chords GROUP BY ALL),
    result AS (SELECT track_id, n_notes, n_beats, n_measures, coalesce(n_chords, 0) AS n_chords, 2 * n_notes + n_tech + 2 * coalesce(n_chords, 0) + n_beats + n_measures AS n_events,
               round(first_us / 1e6, 4) AS first_start FROM _nn JOIN _nb USING (track_id) JOIN _nm USING (track_id) LEFT JOIN _nc USING (track_id))""", recursive=True,
)


def _reports(spark, sf):
    tabs, annotated = _static(spark, sf), _annotated(spark, sf)
    steps = checkpointed(dif.note_steps(tabs, NOTE_SLICE))  # read by the windows, the speed and the report
    passages = dif.difficult_passages(dif.window_scores(tabs, width=NOTE_SLICE, steps=steps), width=NOTE_SLICE)
    sections = dif.practice_sections(passages, dif.technique_stats(annotated))
    docs = writers.report_documents(dif.difficulty_report(tabs, annotated, NOTE_SLICE, steps), passages, sections)
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    writers.write_report(docs, path)
    seen = F.from_json("value", "track_id bigint, overall_rating string, metrics struct<total_notes: bigint>").alias("d")
    return spark.read.text(path).select(seen).select("d.track_id", F.col("d.overall_rating").alias("level"), F.col("d.metrics.total_notes").alias("n"))


register("write_report", _reports, "track_id level$ n")


def _saved(spark, sf):
    from notelake.operators import matching as mt
    from notelake.plans.evaluate import _results
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    results = _results(spark, sf)
    writers.write_results(results, mt.leaderboard(results), path, "20240101_000000")
    writers.write_results(results, mt.leaderboard(results), path, "20240102_000000")
    return writers.latest_results(spark, path)


register("write_results", _saved, "run_id$ method$ n_cases mean_f1~")


def _user_detectors(spark, sf):
    readers.register_detector("octave_up", lambda b: b[b["midi"] > 0].assign(midi=b["midi"] + 12, frequency=440.0 * 2 ** ((b["midi"] + 12 - 69) / 12)))
    readers.register_detector("broken", lambda b: b[["missing"]])
    out = readers.run_detectors(src.frames(spark, sf).select("track_id", "frame", "t_us", "midi", "confidence"), ["octave_up", "broken"])
    return out.filter("error is null")


register(
    "user_detectors", _user_detectors, "track_id frame midi confidence~ method$", "frames",
    "result AS (SELECT track_id, frame, midi + 12 AS midi, confidence, 'octave_up' AS method FROM frames WHERE midi > 0)",
)
