"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notelake.plans import QUERIES  # noqa: E402
from notelake.session import build_session  # noqa: E402

HEADLINE = [
    "ensemble_note_counts", "group_anchored", "group_gap", "vote_onsets", "frames_to_notes_exact", "frames_to_notes_drift", "merge_same_pitch",
    "match_truth", "note_metrics", "leaderboard_by_category", "detect_key", "constrain_to_key", "transition_model", "identify_chords",
    "assign_positions", "difficulty_report", "difficult_passages", "median_smooth", "fast_regions", "legato_onsets", "overlapping_notes",
    "pitch_at_onset", "attack_vs_sustain", "spectral_flux", "spectral_shape", "octave_correct", "peak_pick_spaced", "timeline", "tab_grid",
    "repeated_riffs", "note_offsets", "optimal_fingering", "prefer_lower_frets", "big_merge_same_pitch", "big_phrases", "big_interval_stats", "big_detect_key", "big_speed", "big_drop_harmonics",
]


def timed(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def shuffled(log_dir: str, since: float) -> int:
    """Bytes that tasks launched after ``since`` wrote to shuffles, from the event log."""
    total = 0
    for folder, _, files in os.walk(log_dir):
        for name in files:
            with open(os.path.join(folder, name), errors="replace") as lines:
                for line in lines:
                    if '"SparkListenerTaskEnd"' in line[:60]:
                        event = json.loads(line)
                        if event["Task Info"]["Launch Time"] >= since * 1000:
                            total += (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return total


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    logs = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (
        f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{logs} --conf spark.eventLog.rolling.enabled=false --conf spark.eventLog.compress=false pyspark-shell")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in QUERIES]
    # a whole round on the next smaller tables warms up and gives the growth
    small = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    small = small if small != sf_dir and os.path.isdir(small) else os.path.join(os.path.dirname(sf_dir), "sf0.001")
    before = {n: timed(QUERIES[n], spark, small) for n in names}
    since = time.time()
    times = {n: timed(QUERIES[n], spark, sf_dir) for n in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "growth_from": os.path.basename(small),
        "growth": {n: round(times[n] / max(before[n], 0.001), 2) for n in names}, "shuffle_bytes": shuffled(logs, since),
    }))


if __name__ == "__main__":
    main()
