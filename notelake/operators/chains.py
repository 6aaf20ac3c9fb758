"""Choices along a track that depend on the choice before, by tables that compose.

An item (a note, a chord) is chosen from a short list that it knows by itself. What a slice of items does is then a table from the options
of the item before it to those of its last item: for a greedy rule which option is left with, for a cheapest path what the way costs.
Such tables compose, so those of all slices are combined in rounds that double the reach: after r rounds a table covers 2^r
slices, no task ever holds the slices of a track, and a track of n slices takes log2 n rounds. A slice is then gone through once
more with its true entry. Results are those of one pass over the track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from notelake.operators.timeline import SLICE_US, halo, row_index
from notelake.session import checkpointed

#: About as many rows leave a task at once.
OUT_ROWS = 10_000

#: How two neighbouring tables ``a`` and ``b`` combine, as SQL: functions as arrays of indices, costs as matrices.
THEN = "transform(a, x -> element_at(b, x + 1))"
MIN_PLUS = "transform(a, x -> transform(sequence(0, size(b[0]) - 1), j -> array_min(zip_with(x, b, (c, y) -> c + y[j]))))"


def compose(tables: DataFrame, combine: str, reverse: bool = False) -> DataFrame:
    """(track_id, n, table) with each table combined with all those before it (after it, with ``reverse``), in order of n = 0, 1, ...

    ``tables`` must be stored or checkpointed. A round joins each slice with the one 2^r before it; rounds end when that reaches over the longest track.
    """
    longest = tables.agg(F.max("n")).first()[0]
    step = 1
    while longest is not None and step <= longest:
        shift = -step if reverse else step
        earlier = tables.select("track_id", (F.col("n") + shift).alias("n"), F.col("table").alias("a"))
        both = tables.withColumnRenamed("table", "b").join(earlier, ["track_id", "n"], "left")
        tables = checkpointed(both.select("track_id", "n", F.expr(f"if(a is null, b, {combine})").alias("table")))
        step *= 2
    return tables


def blocks(items: DataFrame, order: Sequence[str], block: int, before: int, after: int, width: int = SLICE_US) -> DataFrame:
    """(track_id, n, items): slices of ``block`` items in ``order``, each with its neighbours; an entry is (rn, own, item)."""
    rows = halo(row_index(items, order, width), "rn", block, before, after)
    entry = F.struct("rn", F.col("_own").alias("own"), F.struct(*[c for c in items.columns if c != "track_id"]).alias("item"))
    pieces = rows.groupBy("track_id", F.col("_s").alias("n")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    # the reach of a track's last items makes slices that own nothing
    return checkpointed(pieces.filter(F.exists("items", lambda e: e["own"])))


def rows_of(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch, one at a time: a row is a whole slice, so those of a batch as Python values would take many times the memory of the batch."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def own_range(entries: list[dict]) -> tuple[int, int]:
    """First and one past the last place of a slice's own entries."""
    own = [i for i, e in enumerate(entries) if e["own"]]
    return own[0], own[-1] + 1


@dataclass(frozen=True)
class Rule:
    """A greedy choice: ``options`` lists what item i of a slice may become, ``choose`` gives the index of the one taken after ``before``
    (an option of item i - 1, None for the first item of a track), ``emit`` the output rows of item i from its option and the one before.
    """

    options: Callable[[list[dict], int], list]
    choose: Callable[[list[dict], int, Any], int]
    emit: Callable[[list[dict], int, Any, Any], list[tuple]]


def choose_along(pieces: DataFrame, rule: Rule, schema: T.StructType) -> DataFrame:
    """Rows of ``rule.emit`` for every item of ``pieces`` (from ``blocks``); ``schema`` is that of track_id followed by the emitted columns."""
    key = T.StructType([pieces.schema["track_id"], T.StructField("n", T.LongType())])

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for track, _, entries, *_ in rows_of(batch):
            first, end = own_range(entries)
            yield track, [e["item"] for e in entries], first, end

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, items, first, end in read(batch):
                states = rule.options(items, first - 1) if first else [None]
                exits = list(range(len(states)))
                for i in range(first, end):
                    taken = {k: rule.choose(items, i, states[k]) for k in dict.fromkeys(exits)}
                    exits = [taken[k] for k in exits]
                    states = rule.options(items, i)
                found.append(exits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["track_id", "n", "table"])

    tables = checkpointed(pieces.mapInArrow(table, T.StructType([*key, T.StructField("table", T.ArrayType(T.IntegerType()))])))
    entry = compose(tables, THEN).select("track_id", (F.col("n") + 1).alias("n"), F.col("table")[0].alias("entry"))
    entered = pieces.join(entry, ["track_id", "n"], "left").select("track_id", "n", "items", F.coalesce("entry", F.lit(0)).alias("entry"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (track, items, first, end), k in zip(read(batch), batch.column(3).to_pylist(), strict=True):
                state = rule.options(items, first - 1)[k] if first else None
                for i in range(first, end):
                    before, state = state, rule.options(items, i)[rule.choose(items, i, state)]
                    out += [(track, *row) for row in rule.emit(items, i, state, before)]
                if len(out) >= OUT_ROWS:
                    yield batch_of(out, arrow_schema)
                    out = []
            if out:
                yield batch_of(out, arrow_schema)

    arrow_schema = to_arrow_schema(schema)
    return entered.mapInArrow(emit, schema)


@dataclass(frozen=True)
class Path:
    """A cheapest path: ``prepare`` makes what is known of each item, ``first`` gives the costs (1 x candidates) of a track's first item,
    ``after`` those (candidates before x candidates) of item i, as whole numbers, ``emit`` the output rows of item i with candidate k.
    """

    prepare: Callable[[list[dict]], list]
    first: Callable[[list], np.ndarray]
    after: Callable[[list, int], np.ndarray]
    emit: Callable[[list[dict], list, int, int], list[tuple]]


def cheapest_along(pieces: DataFrame, path: Path, schema: T.StructType) -> DataFrame:
    """Rows of ``path.emit`` along the cheapest path of every track of ``pieces`` (from ``blocks``).

    Costs are whole numbers, so they add up alike however the path is cut. Of equal paths the one with the earlier candidates, from
    its end on, is taken.
    """
    key = [pieces.schema["track_id"], T.StructField("n", T.LongType())]

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for track, _, entries, *_ in rows_of(batch):
            first, end = own_range(entries)
            items = [e["item"] for e in entries]
            yield track, items, path.prepare(items), first, end

    def steps(known: list, first: int, end: int) -> Iterator[np.ndarray]:
        for i in range(first, end):
            yield path.after(known, i) if i else path.first(known)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, known, first, end in read(batch):
                table = None
                for step in steps(known, first, end):
                    table = step if table is None else np.stack([(row[:, None] + step).min(axis=0) for row in table])
                found.append(table.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["track_id", "n", "table"])

    # a slice's costs matter to those after it, its ways back to those before it: a track of one slice needs neither
    size = pieces.groupBy("track_id").agg(F.max("n").alias("end"))
    pieces = pieces.join(size, "track_id").select("track_id", "n", "items", "end")
    tables = checkpointed(pieces.filter("n < end").mapInArrow(costs, T.StructType([*key, T.StructField("table", T.ArrayType(T.ArrayType(T.LongType())))])))
    reached = compose(tables, MIN_PLUS)  # a track's first table has one row, so each has after that
    entry = reached.select("track_id", (F.col("n") + 1).alias("n"), F.col("table")[0].alias("entry"))
    entered = pieces.join(entry, ["track_id", "n"], "left").select("track_id", "n", "items", "entry", (F.col("n") == F.col("end")).alias("last"))
    entered = checkpointed(entered)

    def ways(known: list, first: int, end: int, entry: list[int] | None) -> tuple[list[np.ndarray], np.ndarray]:
        """For each own item the best candidate before each of its candidates, and the costs at the end."""
        back, v = [], None if entry is None else np.array(entry)
        for step in steps(known, first, end):
            total = step if v is None else v[:, None] + step
            back.append(total.argmin(axis=0))
            v = total.min(axis=0)
        return back, v

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (_, _, known, first, end), entry, last in zip(read(batch), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                back, v = ways(known, first, end, entry)
                state = np.arange(len(v)) if not last else np.array([int(v.argmin())])
                for step in reversed(back):
                    state = step[state]
                found.append(state.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["track_id", "n", "table"])

    tables = checkpointed(entered.filter("n > 0").mapInArrow(backward, T.StructType([*key, T.StructField("table", T.ArrayType(T.IntegerType()))])))
    left = compose(tables, THEN, reverse=True).select("track_id", (F.col("n") - 1).alias("n"), F.col("table")[0].alias("exit"))
    arrow_schema = to_arrow_schema(schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (track, items, known, first, end), entry, state in zip(read(batch), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                back, v = ways(known, first, end, entry)
                state = int(v.argmin()) if state is None else state
                for i in range(end - 1, first - 1, -1):
                    out += [(track, *row) for row in path.emit(items, known, i, state)]
                    state = int(back[i - first][state])
                if len(out) >= OUT_ROWS:
                    yield batch_of(out, arrow_schema)
                    out = []
            if out:
                yield batch_of(out, arrow_schema)

    return entered.drop("last").join(left, ["track_id", "n"], "left").mapInArrow(trace, schema)
