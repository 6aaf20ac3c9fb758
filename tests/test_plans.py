"""Properties of plans: what reaches the scan, and that no operator orders a whole track in one task."""

import random
import re

from pyspark.sql import functions as F

from notelake.operators import joins as jn
from notelake.operators import segment as seg
from notelake.operators import theory as th
from notelake.operators import timeline as tl


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, path):
    df = spark.range(2000).selectExpr("id % 3 as track_id", "id as note_id", "id * 10 as start_us", "5L as dur_us", "cast(40 + id % 5 as int) as midi", "0.5D as confidence", "'x' as payload")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_merge_reads_its_input_once_and_only_its_columns(spark, tmp_path):
    df = table(spark, str(tmp_path / "n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(seg.merge_same_pitch(df, 30))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    assert "payload" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_row_windows_are_cut_into_slices(spark, tmp_path):
    df = table(spark, str(tmp_path / "n"))
    rows = tl.running(df, ["start_us", "note_id"], 1000, prev=tl.previous("midi"))
    text = plan(rows)
    # windows over data rows name the slice; the only windows by track alone run over slice summaries
    data = [w for w in re.findall(r"windowspecdefinition\(([^)]*)", text) if "note_id" in w]
    assert data and all("_s#" in w for w in data)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be merged
    try:
        hot = rows.filter("track_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert hot > 1


def test_filters_reach_the_scan(spark, tmp_path):
    df = table(spark, str(tmp_path / "n")).filter("midi > 42")
    assert "GreaterThan(midi,42)" in plan(seg.phrases(df, 5, 1))


def test_harmonics_meet_their_rows_in_one_shuffle(spark, tmp_path):
    df = table(spark, str(tmp_path / "n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(jn.drop_harmonics(df, 300, 1000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # rows meet their anchors once; pitches come from a window over a group and not from a second copy of the rows
    assert "LeftAnti" not in text and text.count("payload") > 0
    assert sum("payload" in line for line in text.splitlines() if "FileScan" in line) == 1
    # slices know their neighbours by themselves: no window looks back or ahead over all slices of a track
    assert "lag(" not in text and "lead(" not in text


def test_harmonics_of_groups_over_slice_borders(spark):
    rng = random.Random(11)
    rows = [(t, i, rng.randrange(0, 400) * 25, rng.choice([40, 45, 52, 59, 64, 71, None])) for t in range(3) for i in range(160)]
    df = spark.createDataFrame(rows, "track_id long, note_id long, start_us long, midi int").repartition(4)
    want = set()
    for track in range(3):
        groups, anchor = {}, None
        for _, i, t, m in sorted((r for r in rows if r[0] == track), key=lambda r: r[2]):
            if anchor is None or t - anchor >= 100:
                anchor = t
            groups.setdefault(anchor, []).append((i, m))
        want |= {(track, i) for g in groups.values() for i, m in g if m is None or not {m - h for h in jn.HARMONICS} & {x for _, x in g}}
    for width in (10, 1000, 10_000_000):
        assert {(r.track_id, r.note_id) for r in jn.drop_harmonics(df, 100, width).collect()} == want
    assert len(want) < len(rows)


def test_chord_templates_are_scored_once(spark, tmp_path):
    df = table(spark, str(tmp_path / "n"))
    found = th.identify_chords(df, 100, width=1000)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_max(") == 1
    one = spark.createDataFrame([(1, n, t, 5, m, 0.5) for n, (t, m) in enumerate([(0, 60), (10, 64), (20, 67), (5000, 60), (5010, 60), (9000, 61)])],
                                "track_id long, note_id long, start_us long, dur_us long, midi int, confidence double")
    assert [(r.start_us, r.name, r.n_notes) for r in th.identify_chords(one, 100, width=1000).collect()] == [(0, "C", 3)]
