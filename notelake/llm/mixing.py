"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``f`` times its size takes every document ``floor(f)`` times, and once more with inclusion
probability ``f - floor(f)``. The extra copies are drawn by the cube method: the vector of inclusion probabilities moves
inside the unit cube, along directions that keep the totals of documents and of words, until almost every entry is 0 or 1.
Each move looks at three open documents, whose two balancing equations leave one direction free, so the flight reads its rows
once and keeps three of them. It runs side by side over slices of a source; the at most two open documents of each slice are
pooled and fly on in larger slices, until one slice per source is left. Its last open documents are the landing problem, solved
by trying the at most four outcomes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.common import WORD, fields, text_or_empty
from notelake.session import checkpointed

SLICE = 5_000
EPS = 1e-9


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source and size in words (ASCII white space separates, null text has none)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, n, source_size, target, nr (its place by code point, null last).

    Weights repeat along that order. Targets divide ``share`` times all sizes by weight; none exceeds ``most`` times its
    source's size, the excess is divided again among the others. That end state is a level L with target = min(weight * L,
    most * size), found from sums along the order of ``most * size / weight``. The windows see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    nr = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    level_order = W.orderBy((F.col("cap") / F.col("weight")), "nr")
    everything = W.partitionBy(F.lit(0))
    rows = by_source.withColumn("nr", nr).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nr") % len(weights) + 1).cast("int")))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    capped = F.coalesce(F.sum("cap").over(level_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - capped) / F.sum("weight").over(level_order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(level_order))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(fits, F.struct("place", "level"))).over(everything)
    return rows.withColumn("first", first).select(
        "source", "n", "source_size", "nr",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap")).otherwise(F.col("weight") * F.col("first.level")).alias("target"),
    )


def flight(chances: list[float], sizes: Sequence[float], seed: str) -> None:
    """Move ``chances`` in place until at most two are neither 0 nor 1, keeping their sum and their sum weighted by size."""
    rng = random.Random(seed)
    open_: list[int] = []

    def settle() -> list[int]:
        still = []
        for k in open_:
            if chances[k] <= EPS or chances[k] >= 1 - EPS:
                chances[k] = float(round(chances[k]))
            else:
                still.append(k)
        return still

    for k in range(len(chances)):
        open_.append(k)
        open_ = settle()
        while open_:
            if len(open_) == 3:
                a, b, c = (sizes[j] for j in open_)
                u = [b - c, c - a, a - b]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            elif len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]:
                u = [1.0, -1.0]
            else:
                break
            top = max(map(abs, u))
            u = [x / top for x in u]
            ahead = min((1 - chances[j]) / x if x > 0 else chances[j] / -x for j, x in zip(open_, u, strict=True) if x)
            back = min(chances[j] / x if x > 0 else (1 - chances[j]) / -x for j, x in zip(open_, u, strict=True) if x)
            step = ahead if rng.random() * (ahead + back) < back else -back
            for j, x in zip(open_, u, strict=True):
                chances[j] = min(1.0, max(0.0, chances[j] + step * x))
            open_ = settle()


def land(chances: list[float], sizes: Sequence[float]) -> None:
    """Round the last open entries so that the words come closest to their expected total, then the documents."""
    rest = [k for k, p in enumerate(chances) if EPS < p < 1 - EPS]
    best = min(
        range(1 << len(rest)),
        key=lambda pick: (abs(sum(((pick >> i & 1) - chances[k]) * sizes[k] for i, k in enumerate(rest))),
                          abs(sum((pick >> i & 1) - chances[k] for i, k in enumerate(rest))), pick),
        default=0)
    for i, k in enumerate(rest):
        chances[k] = float(best >> i & 1)


def _fly(last: bool, level: int, seed: int):
    def of_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable")
        chances, sizes = pdf["chance"].tolist(), pdf["size"].astype(float).tolist()
        flight(chances, sizes, f"{seed}/{level}/{pdf['nr'].iloc[0]}/{pdf['slice'].iloc[0]}")
        if last:
            land(chances, sizes)
        return pdf.assign(chance=chances)

    return of_slice


def mix(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, per_slice: int = SLICE) -> DataFrame:
    """Adds source_size, target, times (copies that the mix takes, 0 to ``ceil(most)``) and taken (words) to doc_id, source, size.

    Repeated rows are drawn each for itself. A source without words has target 0 and takes nothing. Documents without words are
    drawn like the others and take no words. Null ids and null sources are values like any other. Equal input gives an equal mix.
    """
    sizes = checkpointed(sizes.select("doc_id", "source", "size"))
    targets = checkpointed(source_targets(sizes, weights, share, most))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    slices = F.ceil(F.col("n") / per_slice)
    found = targets.withColumn("factor", factor).withColumnRenamed("source", "_source")
    rows = sizes.join(found, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("copies", F.floor("factor").cast("long")).withColumn("chance", F.col("factor") - F.col("copies"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "size")).withColumn("slice", F.pmod(F.col("order"), slices))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "nr", "copies", "order", "slice", "chance")
    largest = targets.agg(F.max("n")).first()[0] or 0
    parts = max(1, math.ceil(largest / per_slice))
    done, level = [], 0
    while True:
        last = parts == 1
        flown = checkpointed(rows.groupBy("nr", "slice").applyInPandas(_fly(last, level, seed), rows.schema))
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(flown if last else flown.filter(settled))
        if last:
            break
        # two open rows a slice at most, so per_slice // 2 slices make one of the next level
        rows = flown.filter(~settled).withColumn("slice", F.floor(F.col("slice") / (per_slice // 2)).cast("long"))
        parts, level = math.ceil(parts / (per_slice // 2)), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = F.col("copies") + F.col("chance").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their own columns.

    Rows that share id, source and size are told apart by their place among themselves only.
    """
    names = docs.columns
    key = ["_id", "_source", "_size"]
    chosen = mix(sized(docs, text, doc_id, source), **options)
    picks = chosen.groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list(F.col("times"))).alias("_times")).toDF(*key, "_times")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                       F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("_size"))
    rows = rows.withColumn("_nr", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
    left, right = rows.alias("l"), picks.alias("r")
    met = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.get("_times", F.col("_nr") - 1).cast("int")))).select(*fields("_row", names))

