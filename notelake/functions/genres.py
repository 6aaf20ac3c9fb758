"""Fixed genre values: preferred scales with weights, root weights, technique sensitivities, tempo range, shortest note."""

from __future__ import annotations

from dataclasses import dataclass

# Scales used by the genre profiles.
GENRE_SCALES = {
    "minor_pentatonic": [0, 3, 5, 7, 10],
    "major_pentatonic": [0, 2, 4, 7, 9],
    "natural_minor": [0, 2, 3, 5, 7, 8, 10],
    "harmonic_minor": [0, 2, 3, 5, 7, 8, 11],
    "blues": [0, 3, 5, 6, 7, 10],
    "major": [0, 2, 4, 5, 7, 9, 11],
    "dorian": [0, 2, 3, 5, 7, 9, 10],
    "phrygian": [0, 1, 3, 5, 7, 8, 10],
    "phrygian_dominant": [0, 1, 4, 5, 7, 8, 10],
    "locrian": [0, 1, 3, 5, 6, 8, 10],
    "diminished": [0, 2, 3, 5, 6, 8, 9, 11],
}

# Scales a fast run is matched against, in order.
RUN_SCALES = {
    "major": [0, 2, 4, 5, 7, 9, 11],
    "minor": [0, 2, 3, 5, 7, 8, 10],
    "minor_pentatonic": [0, 3, 5, 7, 10],
    "major_pentatonic": [0, 2, 4, 7, 9],
    "blues": [0, 3, 5, 6, 7, 10],
    "dorian": [0, 2, 3, 5, 7, 9, 10],
    "phrygian": [0, 1, 3, 5, 7, 8, 10],
    "mixolydian": [0, 2, 4, 5, 7, 9, 10],
    "harmonic_minor": [0, 2, 3, 5, 7, 8, 11],
    "melodic_minor": [0, 2, 3, 5, 7, 9, 11],
}


@dataclass(frozen=True)
class Genre:
    """``scales`` lists the preferred scales with their weight; a scale without a table here is left out."""

    scales: dict[str, float]
    roots: dict[int, float]
    techniques: dict[str, float]
    tempo: tuple[int, int]
    min_dur_us: int

    def pitch_weights(self, root: int = 0) -> list[float]:
        """Weight of each pitch class, the largest being 1."""
        raw = [
            0.5 + sum(w for name, w in self.scales.items() if (pc - root) % 12 in GENRE_SCALES.get(name, ()))
            for pc in range(12)
        ]
        return [x / max(raw) for x in raw]


# The profiles. ``mixolydian`` has no interval table in this set, so it never adds weight.
GENRES = {
    "metal": Genre(
        scales={"minor_pentatonic": 1.5, "natural_minor": 1.4, "harmonic_minor": 1.2, "phrygian": 1.0,
                "phrygian_dominant": 0.9, "blues": 0.8, "locrian": 0.6, "diminished": 0.5},
        roots={4: 1.5, 9: 1.3, 2: 1.2, 11: 1.1, 7: 1.0, 0: 0.8, 5: 0.7},
        techniques={"bend": 1.3, "vibrato": 1.4, "hammer_on": 1.5, "pull_off": 1.5, "tapping": 1.8, "tremolo": 1.6,
                    "slide": 1.2, "palm_mute": 2.0, "pinch_harmonic": 1.5},
        tempo=(80, 240), min_dur_us=30_000,
    ),
    "rock": Genre(
        scales={"minor_pentatonic": 1.6, "blues": 1.4, "major_pentatonic": 1.2, "natural_minor": 1.0,
                "mixolydian": 1.0, "dorian": 0.9, "major": 0.8},
        roots={4: 1.5, 9: 1.4, 7: 1.3, 2: 1.2, 0: 1.1, 5: 0.9, 11: 0.8},
        techniques={"bend": 1.5, "vibrato": 1.3, "hammer_on": 1.2, "pull_off": 1.2, "slide": 1.3, "tapping": 0.8,
                    "tremolo": 0.9, "double_stop": 1.4},
        tempo=(70, 180), min_dur_us=40_000,
    ),
    "blues": Genre(
        scales={"blues": 1.8, "minor_pentatonic": 1.5, "major_pentatonic": 1.2, "mixolydian": 1.0, "dorian": 0.9},
        roots={4: 1.5, 9: 1.4, 7: 1.2, 0: 1.1, 2: 1.0},
        techniques={"bend": 2.0, "vibrato": 1.8, "slide": 1.5, "hammer_on": 1.0, "pull_off": 1.0},
        tempo=(60, 150), min_dur_us=60_000,
    ),
    "default": Genre(
        scales={"major": 1.0, "natural_minor": 1.0, "minor_pentatonic": 1.0, "major_pentatonic": 1.0},
        roots={pc: 1.0 for pc in range(12)}, techniques={}, tempo=(60, 180), min_dur_us=50_000,
    ),
}
