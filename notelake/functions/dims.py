"""Fixed musical values and the small dimension tables built from them.

Every table here has a fixed number of rows, so a broadcast of any of them stays small whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Note names, tunings (MIDI numbers, low string first), fret count.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
TUNINGS = {
    "standard": [40, 45, 50, 55, 59, 64],
    "drop_d": [38, 45, 50, 55, 59, 64],
    "drop_c": [36, 43, 48, 53, 57, 62],
    "half_step_down": [39, 44, 49, 54, 58, 63],
    "full_step_down": [38, 43, 48, 53, 57, 62],
    "open_d": [38, 45, 50, 54, 57, 62],
    "open_g": [38, 43, 50, 55, 59, 62],
    "dadgad": [38, 45, 50, 55, 57, 62],
}
NUM_FRETS = 24

# Weight of each pitch detector, 1.0 for any other.
METHOD_WEIGHTS = {
    "pyin": 1.0,
    "cqt": 0.8,
    "crepe": 1.5,
    "basic_pitch": 1.2,
    "piptrack": 0.6,
    "hps": 1.3,
    "essentia_yin_fft": 1.3,
    "essentia_yin": 1.1,
    "praat_cc": 1.2,
    "praat_shs": 1.1,
    "yin": 1.4,
    "cepstrum": 1.3,
    "cepstrum_secondary": 0.7,
}

# Weight of each onset detector.
ONSET_WEIGHTS = {
    "spectral_flux": 1.0,
    "complex_domain": 0.9,
    "hfc": 0.8,
    "energy": 0.6,
    "attack": 1.2,
}

# Key profiles (Krumhansl and Kessler) and scales as semitones above the root.
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
SCALES = {
    "major": [0, 2, 4, 5, 7, 9, 11],
    "natural_minor": [0, 2, 3, 5, 7, 8, 10],
    "harmonic_minor": [0, 2, 3, 5, 7, 8, 11],
    "melodic_minor": [0, 2, 3, 5, 7, 9, 11],
    "pentatonic_major": [0, 2, 4, 7, 9],
    "pentatonic_minor": [0, 3, 5, 7, 10],
    "blues": [0, 3, 5, 6, 7, 10],
    "dorian": [0, 2, 3, 5, 7, 9, 10],
    "phrygian": [0, 1, 3, 5, 7, 8, 10],
    "lydian": [0, 2, 4, 6, 7, 9, 11],
    "mixolydian": [0, 2, 4, 5, 7, 9, 10],
    "locrian": [0, 1, 3, 5, 6, 8, 10],
    "chromatic": list(range(12)),
}

# Chord templates as (suffix, semitones above the root), in order of preference.
CHORDS = [
    ("", [0, 4, 7]),
    ("maj", [0, 4, 7]),
    ("m", [0, 3, 7]),
    ("min", [0, 3, 7]),
    ("7", [0, 4, 7, 10]),
    ("maj7", [0, 4, 7, 11]),
    ("m7", [0, 3, 7, 10]),
    ("sus2", [0, 2, 7]),
    ("sus4", [0, 5, 7]),
    ("dim", [0, 3, 6]),
    ("aug", [0, 4, 8]),
    ("add9", [0, 4, 7, 14]),
    ("5", [0, 7]),
]

# Open chord shapes, one fret per string from low to high, x for a muted string.
OPEN_SHAPES = {
    "C": "x 3 2 0 1 0",
    "Am": "x 0 2 2 1 0",
    "G": "3 2 0 0 0 3",
    "D": "x x 0 2 3 2",
    "Dm": "x x 0 2 3 1",
    "E": "0 2 2 1 0 0",
    "Em": "0 2 2 0 0 0",
    "A": "x 0 2 2 2 0",
    "F": "1 3 3 2 1 1",
    "Bm": "x 2 4 4 3 2",
    "B7": "x 2 1 2 0 2",
    "G7": "3 2 0 0 0 1",
    "C7": "x 3 2 3 1 0",
    "D7": "x x 0 2 1 2",
    "A7": "x 0 2 0 2 0",
    "E7": "0 2 0 1 0 0",
}


def lookup(values: Mapping[str, float], key: Column, default: float | None = None) -> Column:
    """A literal map lookup, evaluated in the JVM without a join."""
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


#: Weights of detectors that users have registered; they go before the fixed ones.
REGISTERED_WEIGHTS: dict[str, float] = {}


def method_weight(method: Column, weights: Mapping[str, float] | None = None) -> Column:
    return lookup(weights or {**METHOD_WEIGHTS, **REGISTERED_WEIGHTS}, method, 1.0)


def tuning_notes(tuning: str | Sequence[int] = "standard") -> list[int]:
    """A named tuning, or six comma-separated MIDI numbers."""
    if not isinstance(tuning, str):
        notes = [int(n) for n in tuning]
    elif tuning.lower() in TUNINGS:
        notes = TUNINGS[tuning.lower()]
    else:
        try:
            notes = [int(n) for n in tuning.split(",")]
        except ValueError:
            notes = []
    if len(notes) != 6:
        raise ValueError(f"unknown tuning {tuning!r}; use one of {', '.join(TUNINGS)} or six MIDI numbers")
    return list(notes)





def dim_shape(spark: SparkSession) -> DataFrame:
    rows = [
        (shape, i, s, int(f))
        for i, (shape, frets) in enumerate(OPEN_SHAPES.items())
        for s, f in enumerate(frets.split())
        if f != "x"
    ]
    return spark.createDataFrame(rows, "shape string, ord int, string int, fret int")
