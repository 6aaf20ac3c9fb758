"""Column functions on pitches, times and levels. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.functions.dims import NOTE_NAMES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def midi_to_hz(midi: Column | str) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (_c(midi) - 69) / 12.0)


def hz_to_midi(hz: Column | str) -> Column:
    """Nearest MIDI number, halves to the even side; null for a frequency that is not positive."""
    return F.when(_c(hz) > 0, F.bround(69 + 12 * F.log2(_c(hz) / 440.0)).cast("int"))


def cents(a: Column | str, b: Column | str) -> Column:
    return F.when((_c(a) > 0) & (_c(b) > 0), 1200 * F.log2(_c(a) / _c(b)))


def db(level: Column | str) -> Column:
    return F.when(_c(level) > 0, 20 * F.log10(_c(level)))


def db_to_linear(value: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(value) / 20.0)


def pitch_class(midi: Column | str) -> Column:
    return F.pmod(_c(midi), F.lit(12)).cast("int")


def octave(midi: Column | str) -> Column:
    return (F.floor(_c(midi) / 12) - 1).cast("int")


def pc_name(pc: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), _c(pc).cast("int") + 1)


def note_name(midi: Column | str) -> Column:
    return F.concat(pc_name(pitch_class(midi)), octave(midi).cast("string"))


def letter_pc(letter: Column) -> Column:
    """C..B to 0..11, naturals only."""
    pairs = [(n, i) for i, n in enumerate(NOTE_NAMES) if len(n) == 1]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, letter)


def parse_note(text: Column | str) -> Column:
    """``F#3`` or ``Bb2`` to a MIDI number; null where the text is not a note."""
    pattern = r"^([A-Ga-g])([#b]?)(-?\d+)$"
    letter = F.upper(F.regexp_extract(_c(text), pattern, 1))
    sign = F.regexp_extract(_c(text), pattern, 2)
    octv = F.regexp_extract(_c(text), pattern, 3)
    shift = F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0)
    return F.when(octv != "", ((octv.try_cast("int") + 1) * 12 + letter_pc(letter) + shift)).cast("int")


def parse_key(text: Column | str) -> Column:
    """``Am``, ``C major``, ``F# minor`` to struct(root, mode); null where unknown."""
    pattern = r"^([A-Ga-g])([#b]?)\s*(.*)$"
    trimmed = F.trim(_c(text))
    letter = F.upper(F.regexp_extract(trimmed, pattern, 1))
    sign = F.regexp_extract(trimmed, pattern, 2)
    rest = F.trim(F.regexp_extract(trimmed, pattern, 3))
    shift = F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0)
    root = F.pmod(letter_pc(letter) + shift, F.lit(12)).cast("int")
    low = F.lower(rest)
    mode = F.when((rest == "m") | low.isin("min", "minor"), "minor").when(
        (rest == "") | (rest == "M") | low.isin("maj", "major"), "major"
    )
    return F.when(root.isNotNull() & mode.isNotNull(), F.struct(root.alias("root"), mode.alias("mode")))


def quantize_us(t: Column | str, tempo: int, subdivision: int = 16, swing: float = 0.0) -> Column:
    """Nearest grid line in microseconds (double); odd lines move by ``swing`` of a cell, halves go to the even line."""
    grid = 60_000_000.0 / tempo * 4 / subdivision
    line = F.bround(_c(t) / F.lit(grid))
    out = line * grid
    if swing > 0:
        out = out + F.when(F.pmod(line, F.lit(2)) == 1, F.lit(grid * swing)).otherwise(F.lit(0.0))
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
