"""Most likely note sequence of pitch observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.operators.chains import Path, blocks, cheapest_along
from notelake.operators.segment import mark_groups
from notelake.operators.theory import HIGH, LOW
from notelake.operators.timeline import BLOCK_ROWS, SLICE_US, Run, row_halo, row_index, running, slice_window
from notelake.session import checkpointed

STATES = np.arange(LOW, HIGH + 1)


def _emission(hz: np.ndarray, conf: np.ndarray, std: float = 25.0, octave: float = 0.15) -> np.ndarray:
    """Log probability of each observation under each pitch: Gaussian in cents, some mass on octave errors."""
    spread = (std / (conf + 0.1))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cents = 1200 * np.log2(hz[:, None] / (440.0 * 2 ** ((STATES - 69) / 12)))

    def bell(d: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * (d / spread) ** 2)

    p = (1 - octave) * bell(cents) + octave / 2 * (bell(cents - 1200) + bell(cents + 1200))
    return np.log(np.where(hz[:, None] > 0, np.maximum(p, 1e-10), 1e-10))


def _steps(v: np.ndarray, log_trans: np.ndarray, log_emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best predecessor of every state at each row (the lowest wins ties), and the scores after the last; ``v`` are those before the first."""
    back = np.zeros(log_emit.shape, dtype=np.int64)
    for t, emit in enumerate(log_emit):
        scores = v[:, None] + log_trans
        back[t] = scores.argmax(axis=0)
        v = scores[back[t], np.arange(len(v))] + emit
    return back, v


def _trace(back: np.ndarray, last: int) -> np.ndarray:
    """States at every row, before the first row up to the last, of the path that ends in ``last``."""
    path = np.empty(len(back) + 1, dtype=np.int64)
    path[-1] = last
    for t in range(len(back) - 1, -1, -1):
        path[t] = back[t][path[t + 1]]
    return path


def viterbi(log_prior: np.ndarray, log_trans: np.ndarray, log_emit: np.ndarray) -> tuple[np.ndarray, float]:
    """Best state per row of ``log_emit`` and its log probability; the lowest state wins ties."""
    back, v = _steps(log_prior + log_emit[0], log_trans, log_emit[1:])
    return _trace(back, int(v.argmax())), float(v.max())


def _table(log_trans: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """Best score from each state before the rows to each state at their end."""
    table, into = log_trans + log_emit[0], np.ascontiguousarray(log_trans.T)
    for emit in log_emit[1:]:
        table = (table[:, None, :] + into).max(axis=2) + emit
    return table


#: Slices worked on side by side, and the rows they may hold together.
SIDE = 64
SIDE_ROWS = 20_000


def _doubles(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _side_by_side(batch: pa.RecordBatch, log_trans: np.ndarray, entry: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_steps`` gives, for slices of like length at once: their places in ``batch`` (longest first), lengths, predecessors (row, slice, state) and final scores.

    A slice with a ``prior`` starts its path, and its first row has no predecessors; the others are entered with the scores in column ``entry``.
    """
    into = np.ascontiguousarray(log_trans.T)
    sizes = np.diff(batch.column("hz").offsets.to_numpy())
    begin = np.concatenate([[0], np.cumsum(sizes)])
    hz, conf, prior = _doubles(batch.column("hz")), _doubles(batch.column("confidence")), batch.column("prior")
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        some = order[at:at + max(1, min(SIDE, SIDE_ROWS // max(1, int(sizes[order[at]]))))]
        at += len(some)
        lengths = sizes[some]
        emits = _emission(*[np.concatenate([x[begin[i]:begin[i + 1]] for i in some]) for x in (hz, conf)])
        rows = np.cumsum(lengths) - lengths
        starts = np.array([prior[int(i)].is_valid for i in some])
        v = np.stack([
            np.log(np.maximum(np.asarray(prior[int(i)].as_py(), dtype=float), 1e-10)) if new else np.asarray(batch.column(entry)[int(i)].as_py(), dtype=float)
            for i, new in zip(some, starts, strict=True)])
        back = np.zeros((lengths[0], len(some), len(STATES)), dtype=np.int64)
        for t in range(lengths[0]):
            n = int((lengths > t).sum())
            scores = v[:n, None, :] + into
            back[t, :n] = scores.argmax(axis=2)
            best = np.take_along_axis(scores, back[t, :n, :, None], 2)[:, :, 0]
            if t == 0:
                best = np.where(starts[:, None], v, best)
            v[:n] = best + emits[rows[:n] + t]
        yield some, lengths, back, v


def _back_through(back: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at every row (row, slice, way) of the ways that end in ``last`` (slice, way), and those before the first row."""
    path, state = np.zeros((len(back), *last.shape), dtype=np.int64), last.astype(np.int64)
    for t in range(len(back) - 1, -1, -1):
        n = int((lengths > t).sum())
        path[t, :n] = state[:n]
        state[:n] = np.take_along_axis(back[t, :n], state[:n], 1)
    return path, state


def _chained(rows: DataFrame, fold, schema: str, ascending: bool) -> DataFrame:
    """``fold`` over the slices of each path in order, streaming: one slice summary in memory at a time."""
    placed = rows.repartition("track_id", "first").sortWithinPartitions("track_id", "first", F.col("s") if ascending else F.col("s").desc())

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.track_id, row.first) != key:
                    key, state = (row.track_id, row.first), None
                given, state = fold(state, row)
                out.append((row.track_id, row.first, row.s, given))
            yield pd.DataFrame(out, columns=["track_id", "first", "s", "value"])

    return placed.mapInPandas(stream, schema)


def decode_hmm(
    frames: DataFrame, priors: DataFrame, transitions: DataFrame, max_gap: int | None = None, width: int = BLOCK_ROWS
) -> DataFrame:
    """Decoded pitch per voiced frame (track_id, frame, hz, confidence): one path over MIDI 40-88 for each track.

    ``first`` is the frame at which the path starts. With ``max_gap``, pauses longer than that many frames start a new path from
    the prior; by default a track is one path. A long path is cut into slices of ``width`` frames that are worked on side by
    side and give the path of one plain pass: each slice is summed up as a table from every state before it to every state at
    its end; the tables are chained in order to the scores that enter each slice; with these a slice knows where each exit state
    comes from; chained backwards this gives every slice its exit state, from which it is traced. ``transitions`` has 49 x 49
    rows and goes to the tasks as one array.
    """
    t = np.full((len(STATES), len(STATES)), 1e-10)
    for row in transitions.filter(F.col("a").between(LOW, HIGH) & F.col("b").between(LOW, HIGH)).select("a", "b", "p").collect():
        t[row.a - LOW, row.b - LOW] = max(row.p, 1e-10)
    log_trans = np.log(t)

    voiced = frames.filter("hz > 0").select("track_id", "frame", "hz", "confidence")
    if max_gap is None:
        rows = voiced.join(voiced.groupBy("track_id").agg(F.min("frame").alias("first")), "track_id")
    else:
        rows = running(voiced, ["frame"], width, prev=Run("last", F.col("frame"), inclusive=False))
        cut = F.col("prev").isNull() | (F.col("frame") - F.col("prev") > max_gap)
        rows = mark_groups(rows, ["frame"], cut, width, name="part", drop=["prev"])
        rows = rows.withColumn("first", F.col("part.frame")).drop("part")
    rows = checkpointed(rows.withColumn("s", F.floor(F.col("frame") / width).cast("bigint")).select("track_id", "first", "s", "frame", "hz", "confidence"))
    path = ["track_id", "first"]
    ends = rows.groupBy(*path).agg(F.min("s").alias("s_first"), F.max("s").alias("s_last"))
    prior = priors.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("midi", "p"))).alias("ps")).select("track_id", F.col("ps.p").alias("prior"))
    key = [*path, "s"]
    # a slice is one row; those of a task are worked on side by side
    slices = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("frame", "hz", "confidence"))).alias("o")).join(ends.join(prior, "track_id"), path)
    slices = slices.select(
        *key, "s_last", (F.col("s_first") == F.col("s_last")).alias("alone"), F.when(F.col("s") == F.col("s_first"), F.col("prior")).alias("prior"),
        F.col("o.frame").alias("frames"), F.col("o.hz").alias("hz"), F.col("o.confidence").alias("confidence"))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = checkpointed(slices.repartition(parts, *key))
    alone, long = slices.filter("alone"), slices.filter("not alone")
    names = "track_id long, first long, s long"

    def keyed(batch: pa.RecordBatch, values: list, kind: pa.DataType, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(values, kind)], names=[*key, name])

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: list = [[]] * batch.num_rows  # nothing follows the last slice
            onward = batch.column("s").to_numpy() < batch.column("s_last").to_numpy()
            starts = batch.column("prior").is_valid().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(onward & starts)
            for some, _, _, v in _side_by_side(batch.take(pa.array(first)), log_trans, "prior"):
                for i, scores in zip(first[some], v, strict=True):
                    table[i] = scores
            for i in np.flatnonzero(onward & ~starts):
                one = batch.slice(i, 1)
                table[i] = _table(log_trans, _emission(_doubles(one.column("hz")), _doubles(one.column("confidence")))).ravel()
            yield keyed(batch, table, pa.list_(pa.float64()), "table")

    def forward(state, row):
        table = np.asarray(row.table, dtype=float)
        if not len(table):
            return state, None
        return state, table if state is None else (state[:, None] + table.reshape(len(STATES), -1)).max(axis=0)

    tables = long.mapInArrow(tabulate, f"{names}, table array<double>")
    entering = checkpointed(_chained(tables, forward, f"{names}, value array<double>", True))
    known = long.join(entering, key)

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            came: list = [[]] * batch.num_rows
            best, log_p = [-1] * batch.num_rows, [None] * batch.num_rows
            final = batch.column("s").to_numpy() == batch.column("s_last").to_numpy()
            for some, lengths, back, v in _side_by_side(batch, log_trans, "value"):
                before = _back_through(back, lengths, np.tile(np.arange(len(STATES)), (len(some), 1)))[1]
                for i, states, scores in zip(some, before, v, strict=True):
                    came[i] = states
                    if final[i]:
                        best[i], log_p[i] = int(scores.argmax()), float(scores.max())
            out = keyed(batch, came, pa.list_(pa.int32()), "came").append_column("best", pa.array(best, pa.int32()))
            yield out.append_column("log_p", pa.array(log_p, pa.float64(), from_pandas=True))

    # no slice comes before a first one
    found = checkpointed(known.filter("prior is null").mapInArrow(origins, f"{names}, came array<int>, best int, log_p double"))
    chain = found.unionByName(known.filter("prior is not null").select(*key), allowMissingColumns=True)
    leaving = _chained(chain, lambda state, row: ((row.best if state is None else state), (int(row.came[int(row.best if state is None else state)]) if row.came is not None else None)),
                       f"{names}, value int", False).withColumnRenamed("value", "leaves")
    total = found.filter(F.col("log_p").isNotNull()).select(*path, "log_p")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = "leaves" not in batch.schema.names
            track, first = (batch.column(k).to_numpy() for k in path)
            frame = batch.column("frames").flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(np.diff(batch.column("frames").offsets.to_numpy()))])
            for some, lengths, back, v in _side_by_side(batch, log_trans, "prior" if whole else "value"):
                last = v.argmax(axis=1) if whole else batch.column("leaves").to_numpy()[some]
                states = _back_through(back, lengths, last[:, None])[0][:, :, 0].T[np.arange(len(back)) < lengths[:, None]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(track[some], lengths)), pa.array(np.concatenate([frame[begin[i]:begin[i + 1]] for i in some])),
                    pa.array(np.repeat(first[some], lengths)), pa.array((states + LOW).astype(np.int32)),
                    pa.array(np.repeat(v.max(axis=1), lengths) if whole else np.full(int(lengths.sum()), np.nan), from_pandas=True)],
                    names=["track_id", "frame", "first", "midi", "log_p"])

    schema = "track_id long, frame long, first long, midi int, log_p double"
    plain = alone.mapInArrow(trace, schema).filter(F.col("log_p").isNotNull())
    traced = known.join(leaving, key).mapInArrow(trace, schema).drop("log_p")
    return plain.unionByName(traced.join(total, path).select("track_id", "frame", "first", "midi", "log_p"))


def refine_notes(
    notes: DataFrame, priors: DataFrame, transitions: DataFrame, max_gap: int | None = None, width: int = SLICE_US
) -> DataFrame:
    """Notes (track_id, note_id, start_us, midi, hz, confidence) decoded again as observations; ``changed`` marks other pitches."""
    rows = row_index(notes, ["start_us", "note_id"], width, name="frame")
    path = decode_hmm(rows, priors, transitions, max_gap).select("track_id", "frame", F.col("midi").alias("new_midi"))
    return rows.join(path, ["track_id", "frame"]).withColumn("changed", F.col("new_midi") != F.col("midi")).drop("frame")


# --- decoding over candidates and silence -------------------------------------------------------------------------
#: States are pitches and 0 for silence; costs are whole multiples of this.
UNIT = 1e-6
VOICING = 0.5
SILENCE = 1.0


def jump_cost(semitones: np.ndarray) -> np.ndarray:
    """What a change of pitch from one frame to the next costs."""
    d = np.abs(semitones)
    # fixed values: the bounds of each range of intervals, the cost at its start and the slope
    return np.select(
        [d == 0, d <= 2, d <= 5, d <= 7, d <= 12, d <= 24],
        [0.0, 0.5, 1.0 + 0.2 * (d - 2), 2.0 + 0.3 * (d - 5), 3.0 + 0.5 * (d - 7), 6.0 + 1.0 * (d - 12)], 30.0)


class Reachable:
    """The states that a frame's candidates reach, in order, and what each costs by itself."""

    def __init__(self, item: dict, low: int, high: int):
        cost: dict[int, float] = {}
        for c in item["cands"]:
            voiced = bool(c["is_voiced"]) and c["midi"] is not None and c["midi"] > 0
            state = int(min(high, max(low, np.rint(c["midi"])))) if voiced else 0
            own = -float(np.log(min(0.99, max(0.01, c["confidence"] or 0.0)))) if c["is_voiced"] else SILENCE
            cost[state] = min(own, cost.get(state, own))
        self.states = np.array(sorted(cost))
        self.cost = np.array([cost[s] for s in sorted(cost)])

    def after(self, before: Reachable) -> np.ndarray:
        a, b = before.states[:, None], self.states[None, :]
        step = np.where((a == 0) & (b == 0), 0.0, np.where((a == 0) | (b == 0), VOICING, jump_cost(a - b)))
        return np.rint((step + self.cost) / UNIT).astype(np.int64)

    def first(self) -> np.ndarray:
        return np.rint(self.cost[None, :] / UNIT).astype(np.int64)


def decode_with_silence(candidates: DataFrame, low: int = LOW, high: int = HIGH, width: int = BLOCK_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """(track_id, frame, midi, frequency, confidence, is_voiced): the most likely way through pitches and silence of every track.

    ``candidates``: (track_id, frame, midi, frequency, confidence, is_voiced), any number for a frame. Only the states of a frame's own candidates can be reached in it, so
    what a slice does is a table between the states of two frames. A frame without voiced candidates is silent, one without any row does not exist, and
    its neighbours follow each other. A frame takes frequency and confidence of its surest candidate within half a semitone, or 0.5 and the
    state's own frequency. The lower state wins ties, silence first.
    """
    cand = F.struct((-F.coalesce(F.col("confidence"), F.lit(0.0))).alias("o"), F.col("midi").cast("double").alias("midi"), F.col("frequency").cast("double").alias("frequency"),
                    F.col("confidence").cast("double").alias("confidence"), "is_voiced")
    frames = candidates.groupBy("track_id", "frame").agg(F.array_sort(F.collect_list(cand)).alias("cands"))

    def emit(items: list[dict], known: list[Reachable], i: int, k: int) -> list[tuple]:
        state, frame = int(known[i].states[k]), items[i]["frame"]
        if not state:
            return [(frame, 0, 0.0, 0.0, False)]
        for c in items[i]["cands"]:
            if c["is_voiced"] and c["midi"] is not None and abs(c["midi"] - state) <= 0.5:
                return [(frame, state, c["frequency"], c["confidence"], True)]
        return [(frame, state, 440.0 * 2 ** ((state - 69) / 12), 0.5, True)]

    path = Path(
        prepare=lambda items: [Reachable(item, low, high) for item in items], first=lambda known: known[0].first(),
        after=lambda known, i: known[i].after(known[i - 1]), emit=emit)
    schema = T.StructType([
        candidates.schema["track_id"], candidates.schema["frame"], T.StructField("midi", T.IntegerType()), T.StructField("frequency", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("is_voiced", T.BooleanType())])
    return cheapest_along(blocks(frames, ["frame"], block, 1, 0, width), path, schema)


def smooth_path(path: DataFrame, gap_frames: int = 3, width: int = BLOCK_ROWS) -> DataFrame:
    """``path`` with gaps of at most ``gap_frames`` frames closed by a line in midi, then smoothed and put back to semitones.

    Gaps at the start of a track stay. The Gaussian of one frame runs over the voiced frames alone, as if they were next to each other, mirrored at both ends; a track with three of them
    or fewer is not smoothed. Adds ``filled``.
    """
    voiced = F.when(F.col("is_voiced"), F.struct("frame", F.col("midi").cast("double").alias("midi")))
    rows = running(path.withColumn("_v", voiced), ["frame"], width, drop=["_v"], a=Run("last", F.col("_v"), inclusive=False), b=Run("last", F.col("_v"), inclusive=False, reverse=True))
    gap = F.col("b.frame") - F.col("a.frame") - 1
    fill = F.coalesce(~F.col("is_voiced") & (gap <= gap_frames), F.lit(False))
    t = (F.col("frame") - F.col("a.frame")) / (gap + 1)
    line = F.col("a.midi") + t * (F.col("b.midi") - F.col("a.midi"))
    rows = rows.withColumn("filled", fill).withColumn("m", F.when(fill, line).otherwise(F.col("midi").cast("double"))).drop("a", "b")
    rows = checkpointed(rows.withColumn("is_voiced", F.col("is_voiced") | F.col("filled")))

    reach = 4
    sung = row_halo(rows.filter("is_voiced").select("track_id", "frame", "m"), ["frame"], reach, reach, width)
    count = rows.filter("is_voiced").groupBy("track_id").agg(F.count("*").alias("n"))
    near = slice_window(["track_id"], "rn").rowsBetween(-reach, reach)
    sung = sung.withColumn("xs", F.collect_list("m").over(near)).withColumn("lo", F.min("rn").over(near)).filter("_own").join(count, "track_id")
    weights = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)

    def mirrored(k: int) -> Column:
        m = F.pmod(F.col("rn") + k, 2 * F.col("n"))
        return F.get("xs", (F.when(m >= F.col("n"), 2 * F.col("n") - 1 - m).otherwise(m) - F.col("lo")).cast("int"))

    smooth = sum((mirrored(k - reach) * float(w / weights.sum()) for k, w in enumerate(weights)), F.lit(0.0))
    sung = sung.select("track_id", "frame", F.bround(F.round(F.when(F.col("n") > 3, smooth).otherwise(F.col("m")), 9)).cast("int").alias("smooth"))
    rows = rows.join(sung, ["track_id", "frame"], "left").drop("m")
    hz = F.lit(440.0) * F.pow(F.lit(2.0), (F.col("smooth") - 69) / 12.0)
    return rows.withColumn("midi", F.coalesce("smooth", F.lit(0))).withColumn("frequency", F.when(F.col("is_voiced"), hz).otherwise(0.0)).drop("smooth")
