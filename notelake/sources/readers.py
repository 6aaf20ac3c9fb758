"""JSON inputs with declared schemas, benchmark planning, user detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.dims import REGISTERED_WEIGHTS

TRUTH_SCHEMA = (
    "name string, sample_rate int, duration double, notes array<struct<midi_note int, note_name string, frequency_hz double, "
    "start_time double, end_time double, duration double, velocity double, string int, fret int>>"
)
# every name a note field has had; a file may hold an object with ``notes`` or a bare list
DETECTION_FIELDS = (
    "midi int, midi_note int, pitch double, time double, start_time double, onset double, end_time double, duration double, confidence double, "
    "frequency double, technique string, method string, votes int"
)
DETECTION_SCHEMA = f"notes array<struct<{DETECTION_FIELDS.replace(' ', ': ').replace(',:', ',')}>>, {DETECTION_FIELDS}"
# Technique letters of the tab notation.
TECHNIQUE_LETTERS = {"h": "hammer_on", "p": "pull_off", "/": "slide_up", "\\": "slide_down", "b": "bend", "~": "vibrato", "PM": "palm_mute"}
CANDIDATES = "track_id long, cand_id long, t_us long, frame long, midi int, frequency double, confidence double, method string"


def _us(seconds):
    return F.bround(seconds * 1_000_000).cast("bigint")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per case to one row per note; a missing velocity reads 1.0."""
    docs = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())
    rows = docs.select("name", "file", F.posexplode("notes").alias("pos", "n"))
    return rows.select(
        F.col("name").alias("case"), F.col("pos").cast("bigint").alias("truth_id"), F.col("n.midi_note").alias("midi"),
        _us(F.col("n.start_time")).alias("start_us"), (_us(F.col("n.end_time")) - _us(F.col("n.start_time"))).alias("dur_us"),
        F.coalesce("n.velocity", F.lit(1.0)).alias("velocity"), F.col("n.string").alias("string"), F.col("n.fret").alias("fret"))


def read_detections(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Note JSON of any known shape to one notes table: names are reconciled, bare lists and ``notes`` objects both read."""
    files = [paths] if isinstance(paths, str) else list(paths)
    docs = spark.read.schema(DETECTION_SCHEMA).json(files, multiLine=True).withColumn("file", F.input_file_name())
    fields = [f.strip().split()[0] for f in DETECTION_FIELDS.split(",")]
    nested = docs.filter("notes is not null").select("file", F.explode("notes").alias("n")).select("file", "n.*")
    bare = docs.filter("notes is null").select("file", *fields)
    rows = nested.unionByName(bare, allowMissingColumns=True)
    start = F.coalesce("start_time", "time", "onset", F.lit(0.0))
    dur = F.coalesce("duration", F.col("end_time") - start, F.lit(0.1))
    # ``pitch`` is a MIDI number in note lists and Hz in technique lists
    from_pitch = F.when(F.col("technique").isNull(), F.col("pitch").cast("int")).when(F.col("pitch") > 0, F.bround(69 + 12 * F.log2(F.col("pitch") / 440.0)).cast("int"))
    letters = F.create_map(*[F.lit(x) for kv in TECHNIQUE_LETTERS.items() for x in kv])
    return rows.select(
        "file", F.coalesce("midi", "midi_note", from_pitch, F.lit(0)).alias("midi"), _us(start).alias("start_us"), _us(dur).alias("dur_us"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "frequency", F.coalesce(F.try_element_at(letters, F.col("technique")), "technique").alias("technique"), "method", "votes")


def plan_cases(cases: DataFrame, methods: Sequence[str], present: DataFrame) -> DataFrame:
    """Every case that has its files, with every method."""
    kept = cases.join(present.select("case").distinct(), "case", "left_semi")
    return kept.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


DETECTORS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register_detector(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """``fn`` takes a batch of frame rows and returns (track_id, frame, t_us, midi, frequency, confidence) rows."""
    DETECTORS[name] = fn


def register_weights(weights: dict[str, float]) -> None:
    """Weights of user detectors in every vote that has no table of its own; a method without one counts 1.0."""
    REGISTERED_WEIGHTS.update(weights)


def run_detectors(frames: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of all detectors over all frames, Arrow batch by batch.

    A detector that fails on a batch yields one row with its name and the ``error`` there; the others go on. Batches
    follow the input partitions, so a detector that needs neighbouring frames gets them by a halo or window before.
    """
    chosen = {n: DETECTORS[n] for n in (names or list(DETECTORS))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["track_id", "frame", "t_us", "midi", "frequency", "confidence"]
        for batch in batches:
            for name, fn in chosen.items():
                try:
                    out = fn(batch)[cols].assign(method=name, error=None)
                except Exception as error:  # noqa: BLE001 - one detector's failure must not stop the others
                    out = pd.DataFrame([{**{c: None for c in cols}, "method": name, "error": f"{type(error).__name__}: {error}"}])
                yield out

    return frames.mapInPandas(
        run, "track_id long, frame long, t_us long, midi int, frequency double, confidence double, method string, error string")
