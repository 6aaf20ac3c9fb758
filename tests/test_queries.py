"""Registered queries against their SQL twins on the smallest tables (tools/check_queries.py runs them all)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import canonical  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [
    "ensemble_notes", "vote_onsets", "frames_to_notes_exact", "frames_to_notes_drift", "merge_same_pitch", "legato_runs", "tremolo_sections",
    "match_truth", "note_metrics", "detect_key", "constrain_to_key", "identify_chords", "triplets", "assign_positions", "difficulty_report",
    "fill_gaps", "legato_notes", "tap_patterns", "timeline", "tab_grid", "sustained_uncovered", "drop_harmonics", "spectral_shape",
    "octave_correct", "octave_correct_tuning", "prefer_lower_frets", "smooth_positions", "trills", "level_candidates", "distortion_features", "merge_consecutive",
    "compare_note_runs", "legato_jumps", "annotate_techniques", "quality_metrics", "stream_phrases", "note_offsets", "coalesce_detectors", "before_after_quality",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = con.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_runs_and_all_oracles_have_a_query(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
