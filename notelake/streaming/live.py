"""Operators on a live feed of candidates or notes. Event time is ``ts``; late rows beyond the watermark are dropped."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from notelake.functions.dims import METHOD_WEIGHTS
from notelake.functions.scalars import pitch_class
from notelake.operators.theory import with_key
from notelake.operators.voting import HOP_US
from notelake.session import checkpoint_dir


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet folder as a stream; files are picked up as they arrive."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def replay(stream: DataFrame, mode: str, finish: Callable[[], None] | None = None) -> tuple[DataFrame, int]:
    """Run a stream over all input there is now into a new table; return it and the number of rows dropped as late.

    Complete mode rewrites the table, append mode adds to it; each batch writes its own folder, so a replayed batch
    replaces itself instead of adding rows twice. With ``finish`` the stream goes on from its progress once more after
    that call, which may end the feed (``EndMark.set``).
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    schema = stream.schema
    dropped: dict[int, int] = {}
    running: list[StreamingQuery] = []

    def count() -> None:
        for query in running:  # progress is kept for the last hundred batches only, so it is read along the way
            for p in query.recentProgress:
                dropped[p["batchId"]] = max(dropped.get(p["batchId"], 0), sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]))

    def keep(batch: DataFrame, batch_id: int) -> None:
        target = f"{base}/table/batch={0 if mode == 'complete' else batch_id}"
        batch.write.mode("overwrite").parquet(target)
        count()

    for act in [None] if finish is None else [None, finish]:
        if act:
            act()
        running[:] = [stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(keep).start()]
        running[0].awaitTermination()
        count()
    return spark.read.schema(schema).parquet(f"{base}/table"), sum(dropped.values())


def drain(stream: DataFrame, mode: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """The table of ``replay``."""
    return replay(stream, mode, finish)[0]


class EndMark:
    """Ends a feed: ``set`` adds one row without a track, far in the future, so the watermark passes all rows held.

    ``stream`` is the feed with the folder of the mark beside it. Rows that come after the mark are late.
    """

    def __init__(self, feed: DataFrame) -> None:
        self.spark, self.folder = feed.sparkSession, f"{checkpoint_dir(feed.sparkSession)}/end-{uuid.uuid4().hex}"
        self.schema = StructType([StructField(f.name, f.dataType) for f in feed.schema])
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.stream = feed.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def set(self) -> None:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != "ts"]
        mark = self.spark.range(1).select(*nulls, F.expr("timestamp '2200-01-01 00:00:00'").alias("ts"))
        mark.coalesce(1).write.mode("append").parquet(self.folder)


def stream_density(notes: DataFrame, window: str = "1 second", step: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Notes per sliding window and track."""
    return notes.withWatermark("ts", delay).groupBy("track_id", F.window("ts", window, step).alias("w")).agg(F.count("*").alias("n")).select(
        "track_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")


def stream_phrases(notes: DataFrame, gap: str = "300 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Phrases as session windows: a pause of ``gap`` between onsets ends one."""
    return notes.withWatermark("ts", delay).groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n"), F.min("midi").alias("low"), F.max("midi").alias("high")).select(
        "track_id", F.col("w.start").alias("w_start"), "n", "low", "high")


def stream_dedupe(notes: DataFrame, slot_us: int = 50_000, delay: str = "10 seconds") -> DataFrame:
    """One note per track, pitch and time slot."""
    slot = F.floor(F.unix_micros("ts") / slot_us).cast("bigint")
    return notes.withColumn("slot", slot).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["track_id", "midi", "slot"])


def stream_pitch_histogram(notes: DataFrame, window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Pitch-class weights per tumbling window and track, and the key they suggest."""
    pc = pitch_class("midi")
    sums = F.array(*[F.coalesce(F.sum(F.when(pc == i, F.col("weight"))), F.lit(0)).cast("double") for i in range(12)])
    rows = notes.withWatermark("ts", delay).groupBy("track_id", F.window("ts", window).alias("w")).agg(sums.alias("hist"))
    rows = with_key(rows)
    return rows.select("track_id", F.col("w.start").alias("w_start"), "hist", "k.root", "k.mode", "k.confidence")


CONSENSUS = (
    "track_id long, midi int, start_us long, end_us long, confidence double, frequency double, votes int, pitch_spread double, "
    "n_merged int, methods array<string>"
)


def _voted(rows: list[list], tol_cents: float, min_votes: int, min_score: float, hop_us: int) -> list[dict]:
    """Consensus notes of one closed group of [t, midi, confidence, frequency, method] rows, by start, then pitch."""
    pitches: dict[int, list[list]] = {}
    for r in rows:
        pitches.setdefault(r[1], []).append(r)
    clusters: dict[int, list[list]] = {}
    before, mean_before, taken = None, 0.0, False
    for midi in sorted(pitches):
        mean = sum(r[3] for r in pitches[midi]) / len(pitches[midi])
        near = before == midi - 1 and mean > 0 and mean_before > 0 and abs(1200 * math.log2(mean / mean_before)) <= tol_cents
        taken = near and not taken  # inside a run of close neighbours every other pitch belongs to the one below
        clusters.setdefault(midi - 1 if taken else midi, []).extend(pitches[midi])
        before, mean_before = midi, mean
    out = []
    for base, same in clusters.items():
        w = [METHOD_WEIGHTS.get(r[4], 1.0) * r[2] for r in same]
        total, methods = sum(w), sorted({r[4] for r in same})
        votes = len(methods)
        if votes < min_votes or total / len(same) < min_score / votes or total < 1e-10:
            continue
        mean = lambda i, w=w, same=same, total=total: sum(x * r[i] for x, r in zip(w, same, strict=True)) / total
        low, high = min(r[3] for r in same), max(r[3] for r in same)
        out.append({
            "midi": round(mean(1)), "start_us": min(r[0] for r in same), "end_us": max(r[0] for r in same) + hop_us, "base": base,
            "confidence": min(1.0, mean(2) * (1 + (votes - min_votes) * 0.1)), "frequency": mean(3), "votes": votes, "methods": methods,
            "pitch_spread": 1200 * math.log2(high / low) if len(same) > 1 and low > 0 else 0.0,
        })
    return sorted(out, key=lambda n: (n["start_us"], n["base"]))


def _merged(note: dict | None, more: dict) -> dict:
    """A note still open and the next one of its pitch; confidence and frequency are kept as sums weighted by votes."""
    v = more["votes"]
    add = {**more, "confidence": more["confidence"] * v, "frequency": more["frequency"] * v, "all_votes": v, "n_merged": 1}
    if note is None:
        return add
    sums = {c: note[c] + add[c] for c in ("confidence", "frequency", "all_votes", "n_merged")}
    return {**note, **sums, "end_us": max(note["end_us"], add["end_us"]), "votes": max(note["votes"], v),
            "pitch_spread": max(note["pitch_spread"], add["pitch_spread"]), "methods": sorted({*note["methods"], *add["methods"]})}


def stream_consensus(
    candidates: DataFrame, tol_us: int = 30_000, tol_cents: float = 50.0, min_votes: int = 2, min_score: float = 1.5, min_conf: float = 0.5,
    min_dur_us: int = 50_000, hop_us: int = HOP_US, delay: str = "10 seconds",
) -> DataFrame:
    """The notes of ``voting.ensemble_notes`` from a live feed (``track_id, ts, midi, confidence, frequency, method``).

    Rows are settled in time order once the watermark has passed the group they open, so no group depends on the order of
    arrival: they are grouped, pitches paired, voted, and touching notes of a pitch merged. A note is given out when no
    later group can touch it. State per track holds the rows not yet safe from late ones (the watermark delay plus one
    group) and at most one open note a pitch. Rows with a null in any of these columns take no part. Late rows are
    dropped; ``replay`` counts them and, with an ``EndMark``, gives out what a feed still holds at its end.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, kept = json.loads(state.get[0]) if state.exists else ([], [])
        notes = {n["midi"]: n for n in kept}
        for pdf in batches:
            pdf = pdf.dropna()
            held += [[int(t), int(m), float(c), float(f), str(d)] for t, m, c, f, d in
                     zip(pdf["t_us"], pdf["midi"], pdf["confidence"], pdf["frequency"], pdf["method"], strict=True)]
        held.sort()
        safe = state.getCurrentWatermarkMs() * 1000
        done: list[dict] = []
        start = 0
        while start < len(held) and held[start][0] + tol_us < safe:
            stop = start
            while stop < len(held) and held[stop][0] - held[start][0] <= tol_us:
                stop += 1
            for note in _voted(held[start:stop], tol_cents, min_votes, min_score, hop_us):
                last = notes.get(note["midi"])
                if last and note["start_us"] > last["end_us"] + tol_us:
                    done.append(last)
                    last = None
                notes[note["midi"]] = _merged(last, note)
            start = stop
        held = held[start:]
        first = min(held[0][0], safe) if held else safe  # no later group starts before
        done += [n for n in notes.values() if n["end_us"] + tol_us < first]
        notes = {m: n for m, n in notes.items() if n["end_us"] + tol_us >= first}
        due = [r[0] for r in held[:1]] + [n["end_us"] for n in notes.values()]
        if due:
            state.update((json.dumps([held, list(notes.values())]),))
            state.setTimeoutTimestamp(max((min(due) + tol_us) // 1000 + 2, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for n in done:
            n["confidence"], n["frequency"] = n["confidence"] / n["all_votes"], n["frequency"] / n["all_votes"]
        done = [n for n in done if n["confidence"] >= min_conf and n["end_us"] - n["start_us"] >= min_dur_us]
        if done:
            yield pd.DataFrame(done).assign(track_id=key[0])[[f.split()[0] for f in CONSENSUS.split(", ")]]

    rows = candidates.withColumn("t_us", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.select("track_id", "ts", "t_us", "midi", "confidence", "frequency", "method").groupBy("track_id").applyInPandasWithState(
        step, CONSENSUS, "held string", "append", GroupStateTimeout.EventTimeTimeout)
