"""Readers, sinks, user detectors and the streaming consensus."""

import json
import os
import random
import time
import uuid

import pandas as pd
from pyspark.sql import functions as F

from notelake.operators import difficulty as dif
from notelake.operators import export as ex
from notelake.operators import voting as vote
from notelake.plans import feeds
from notelake.session import checkpoint_dir
from notelake.sources import readers, writers
from notelake.streaming import live

EPOCH = 1_704_067_200_000_000
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


def test_read_truth(spark):
    rows = {(r.case, r.truth_id): r for r in readers.read_truth(spark, f"{DATA}/truth").collect()}
    assert len(rows) == 3
    first = rows[("chord_Am", 0)]
    assert (first.midi, first.start_us, first.dur_us, first.velocity, first.fret) == (45, 100_000, 1_400_000, 0.7, None)
    assert rows[("chord_Am", 1)].velocity == 1.0 and rows[("single_E2", 0)].dur_us == 500_000


def test_read_detections(spark):
    rows = readers.read_detections(spark, f"{DATA}/detections").orderBy("start_us").collect()
    got = [(r.midi, r.start_us, r.dur_us, r.technique) for r in rows]
    assert got == [(43, 70_000, 160_000, "bend"), (55, 139_000, 151_000, None), (60, 500_000, 100_000, None), (45, 1_044_800, 23_200, None)]


def test_results_replace_a_run_and_latest_wins(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "method string, n int")
    b = spark.createDataFrame([("y", 2)], "method string, n int")
    path = str(tmp_path / "out")
    writers.write_results(a, a, path, "20240101")
    writers.write_results(a, b, path, "20240102")
    writers.write_results(b, b, path, "20240101")
    assert [(r.run_id, r.method) for r in writers.latest_results(spark, path).collect()] == [("20240102", "y")]
    assert sorted(r.method for r in spark.read.parquet(f"{path}/results").collect()) == ["x", "y"]


def test_sync_documents_split_long_tracks(spark):
    tabs = spark.createDataFrame(
        [(1, 0, 0, 100, 40, 0, 0, None), (1, 1, 500, 100, 41, 0, 1, "bend"), (1, 2, 1500, 100, 42, 0, 2, None)],
        "track_id long, note_id long, start_us long, dur_us long, midi int, string int, fret int, technique string")
    chords = spark.createDataFrame([(1, 0, 600, "C")], "track_id long, start_us long, dur_us long, name string")
    beats = spark.createDataFrame([(1, 0, 1, 1, True)], "track_id long, t_us long, beat long, measure long, is_downbeat boolean")
    bars = spark.createDataFrame([(1, 1, 0, 1600, 1)], "track_id long, measure long, start_us long, end_us long, beats long")
    docs = {r.part: json.loads(r.document) for r in writers.sync_documents(tabs, chords, beats, bars, 120, 1000).collect()}
    assert [n["id"] for n in docs[0]["tab_data"]["notes"]] == [0, 1] and [n["id"] for n in docs[1]["tab_data"]["notes"]] == [2]
    assert docs[0]["timeline"]["events"][0]["type"] == "measure"
    assert docs[0]["metadata"]["total_notes"] == 3


def test_failing_detector_is_isolated(spark):
    readers.register_detector("copy", lambda b: b.assign(frequency=1.0))
    readers.register_detector("bad", lambda b: b[["nothing"]])
    frames = spark.createDataFrame([(1, 0, 0, 60, 0.5)], "track_id long, frame long, t_us long, midi int, confidence double")
    rows = readers.run_detectors(frames, ["copy", "bad"]).collect()
    assert sorted((r.method, r.error is None) for r in rows) == [("bad", False), ("copy", True)]


def _fed(spark, rows, files, delay):
    """Notes and late rows of a feed that arrives file by file (rows of several files each in its own order)."""
    folder = f"{checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    schema = "track_id long, cand_id long, t_us long, midi int, method string, confidence double, frequency double"
    for i in range(files):
        part = spark.createDataFrame(rows[i * len(rows) // files:(i + 1) * len(rows) // files], schema)
        part.withColumn("ts", F.timestamp_micros(F.col("t_us") + EPOCH)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are read by time of writing
    feed = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    end = live.EndMark(feed)
    out, late = live.replay(live.stream_consensus(end.stream, delay=delay), "append", end.set)
    return _notes(out.collect(), EPOCH), late


def _notes(rows, shift=0):
    return sorted((r.track_id, r.midi, r.start_us - shift, r.end_us - shift, r.votes, r.n_merged, ",".join(r.methods), round(r.confidence, 7),
                   round(r.frequency, 6), round(r.pitch_spread, 6)) for r in rows)


def _feed_rows(n, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        midi = 60 + rng.choice([0, 1, 1, 2, 5])
        cents = rng.uniform(-60, 60)
        rows.append((1 + i % 2, i, rng.randrange(n * 3_000), midi, rng.choice(["pyin", "yin", "cqt", "hps"]), rng.uniform(0.5, 1.0), 440 * 2 ** ((midi - 69 + cents / 100) / 12)))
    return sorted(rows, key=lambda r: r[2])


def test_streaming_consensus_equals_batch(spark):
    rows = _feed_rows(3000)
    schema = "track_id long, cand_id long, t_us long, midi int, method string, confidence double, frequency double"
    want = _notes(vote.ensemble_notes(spark.createDataFrame(rows, schema)).collect())
    rng = random.Random(6)  # arrival out of order within half a second
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(500_000))
    got, late = _fed(spark, arrived, 6, "2 seconds")
    assert len(want) > 100 and max(n[5] for n in want) > 1 and got == want and late == 0


def test_streaming_consensus_counts_late_rows_and_skips_nulls(spark):
    rows = _feed_rows(400)
    schema = "track_id long, cand_id long, t_us long, midi int, method string, confidence double, frequency double"
    want = _notes(vote.ensemble_notes(spark.createDataFrame(rows, schema)).collect())
    nulls = [(None, 1, 5_000, 60, "pyin", 0.9, 261.0), (1, 2, 5_000, None, "pyin", 0.9, 261.0), (1, 3, 5_000, 60, None, 0.9, 261.0),
             (1, 4, 5_000, 60, "pyin", None, 261.0), (1, 5, 5_000, 60, "pyin", 0.9, None)]
    late = [(1, 900 + i, 1_000 * i, 61, "yin", 0.9, 277.0) for i in range(100)]
    assert _fed(spark, nulls + rows, 2, "1 second")[0] == want
    got, dropped = _fed(spark, rows + late, 5, "100 milliseconds")  # the last file holds the late rows only
    assert got == want and dropped == 100
    assert _fed(spark, [], 1, "1 second") == ([], 0)


def test_documents_sort_their_rows_without_a_comparator(spark):
    tabs = spark.createDataFrame([(1, n, (n * 37 % 11) * 1000, 500, 60, 1, n % 9, None) for n in range(40)],
                                 "track_id long, note_id long, start_us long, dur_us long, midi int, string int, fret int, technique string").repartition(4)
    chords = spark.createDataFrame([(1, 3000, 10, "C"), (1, 1000, 10, "D"), (2, 5000, 10, "E")], "track_id long, start_us long, dur_us long, name string")
    ends = spark.createDataFrame([(1, 400_000), (2, 100_000)], "track_id long, dur_us long")
    docs = writers.sync_documents(tabs, chords, ex.beats(ends, 480), ex.measures(ends, 480), 480)
    got = {r.track_id: json.loads(r.document) for r in docs.collect()}
    assert [x["id"] for x in got[1]["tab_data"]["notes"]] == sorted(range(40), key=lambda n: (n * 37 % 11, n))
    assert [x["name"] for x in got[1]["tab_data"]["chords"]] == ["D", "C"] and [x["name"] for x in got[2]["tab_data"]["chords"]] == ["E"]
    events = [(x["time"], x["type"] != "measure") for x in got[1]["timeline"]["events"]]
    assert events == sorted(events) and set(got[1]["timeline"]["events"][0]) == {"time", "type", "data"}
    text = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in text and "array_sort(" not in text


def test_windows_speed_and_report_read_the_steps_once(spark):
    rng = random.Random(3)
    rows = [(n % 2, n, rng.randrange(0, 6_000_000), rng.randrange(6), rng.randrange(0, 20), "bend" if n % 5 == 0 else None) for n in range(150)] + [(None, 900, 5, 1, 1, None), (1, 901, None, 1, 1, None)]
    tabs = spark.createDataFrame(rows, "track_id long, note_id long, start_us long, string int, fret int, technique string").repartition(4)
    steps = dif.note_steps(tabs, 700_000).localCheckpoint()
    both = [(dif.window_scores(tabs, width=700_000), dif.window_scores(tabs, width=700_000, steps=steps)), (dif.speed(tabs, width=700_000), dif.speed(tabs, width=700_000, steps=steps)),
            (dif.difficulty_report(tabs, tabs, 700_000), dif.difficulty_report(tabs, tabs, 700_000, steps))]
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for alone, shared in both:
        assert plain(alone) == plain(shared) and "Window" not in shared._jdf.queryExecution().optimizedPlan().toString()
    # against a walk of each track
    got = {r.track_id: r for r in both[2][1].collect()}
    for track in (0, 1):
        walk = sorted((s, n, st, fr) for t, n, s, st, fr, _ in rows if t == track and s is not None)
        spans = [(lambda near: max(near) - min(near) if near else 0)([f for s, _, _, f in walk if abs(s - at) <= 500_000 and f > 0]) for at, *_ in walk]
        assert (got[track].n, got[track].max_span, got[track].string_changes) == (len(walk), max(spans), sum(a[2] != b[2] for a, b in zip(walk, walk[1:])))


def test_reports_are_written_whole_and_read_back(spark, monkeypatch):
    """The query used to hand back its documents without the sink, and they left out techniques and the times of sections."""
    used = ["bend"] * 4 + ["hammer_on"] * 3 + ["pull_off"] * 2 + ["slide", "harmonic", None]
    rows = [(1, n, n * 90_000, n % 6, 14 * (n % 2) + 1, used[n % len(used)]) for n in range(48)]  # fast and wide
    rows += [(2, 100 + n, n * 1_000_000, 2, 3, None) for n in range(5)]  # nothing hard
    tabs = spark.createDataFrame(rows, "track_id long, note_id long, start_us long, string int, fret int, technique string").repartition(3)
    monkeypatch.setattr(feeds, "_static", lambda spark, sf: tabs.drop("technique"))
    monkeypatch.setattr(feeds, "_annotated", lambda spark, sf: tabs)
    paths, write = [], writers.write_report
    monkeypatch.setattr(writers, "write_report", lambda docs, path: (paths.append(path), write(docs, path)))
    got = {r.track_id: r for r in feeds._reports(spark, "").collect()}
    assert len(paths) == 1
    docs = {d["track_id"]: d for d in (json.loads(r.value) for r in spark.read.text(paths[0]).collect())}
    assert {t: (r.level, int(r.n)) for t, r in got.items()} == {t: (d["overall_rating"], d["metrics"]["total_notes"]) for t, d in docs.items()}
    assert sorted(docs) == [1, 2] and (docs[1]["metrics"]["total_notes"], docs[2]["metrics"]["total_notes"]) == (48, 5)
    for d in docs.values():
        assert set(d) == {"track_id", "overall_rating", "overall_score", "metrics", "techniques", "sub_ratings", "difficult_passages", "practice_sections"}
        assert set(d["metrics"]) == {"total_notes", "max_fret_span", "max_fret_used", "avg_fret_span", "max_notes_per_second", "avg_notes_per_second",
                                     "unique_positions", "string_changes", "position_changes"}
        assert set(d["sub_ratings"]) == {"speed", "technique", "stretch", "position"}
    assert docs[1]["techniques"] == {"hammer_ons": 12, "pull_offs": 8, "bends": 16, "slides": 4, "vibrato": 0, "trills": 0, "tremolo": 0, "harmonics": 0, "palm_mutes": 0}
    (passage,) = docs[1]["difficult_passages"]
    assert (passage["start_time"], passage["end_time"], passage["difficulty_score"]) == (0.0, 6.0, 1.0) and set(passage) == {"start_time", "end_time", "reason", "difficulty_score"}
    first, bends, legato = docs[1]["practice_sections"]
    assert (first["start_time"], first["end_time"], first["difficulty"]) == (0.0, 6.0, "advanced") and first["focus"] == passage["reason"].split(";")[0]
    assert {"finger stretches", "isolate the shift"} < set(first["tips"]) and (bends["start_time"], len(bends["tips"]), len(legato["tips"])) == (0.0, 3, 3)
    assert docs[2]["difficult_passages"] == [] == docs[2]["practice_sections"]
