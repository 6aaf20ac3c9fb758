"""Ordered computations along a track that never put a whole track into one task.

A track is cut into *slices* of its own axis (time, frame number or row number). Rows are shuffled by
``(track, slice)``, so one endless recording spreads over as many tasks as it has slices. What a slice needs from
its neighbours travels in one of two ways:

* ``halo``: rows within a fixed reach of a border are also sent to the neighbour (lag/lead and frames whose reach
  is bounded in time or rows);
* ``running``: one summary row per slice is scanned over the track and joined back (prefix sums, running maxima,
  last value seen, previous and next row however far away).

The summaries hold one row per slice, thousands of times fewer rows than the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_US = 10_000_000
BLOCK_ROWS = 4096
TRACK = ("track_id",)


def slice_of(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def sliced(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_s", slice_of(F.col(pos), width))


def halo(df: DataFrame, pos: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Add ``_s`` and ``_own``; copies go to slices that look ``before`` back or ``after`` ahead to the row."""
    p = F.col(pos)
    home = slice_of(p, width)
    if not before and not after:
        return df.withColumn("_s", home).withColumn("_own", F.lit(True))
    reach = F.sequence(slice_of(p - after, width), slice_of(p + before, width))
    return df.withColumn("_s", F.explode(reach)).withColumn("_own", F.col("_s") == home)


def slice_window(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys, "_s").orderBy(*order)


@dataclass(frozen=True)
class Run:
    """One running value: ``sum``, ``max`` or ``last`` non-null of ``expr``.

    ``inclusive`` counts the current row; ``reverse`` runs from the end of the track.
    """

    kind: str
    expr: Column
    inclusive: bool = True
    reverse: bool = False


def previous(*cols: str) -> Run:
    return Run("last", F.struct(*cols), inclusive=False)


def following(*cols: str) -> Run:
    return Run("last", F.struct(*cols), inclusive=False, reverse=True)


def _over(kind: str, expr: Column, window) -> Column:
    if kind == "sum":
        return F.sum(expr).over(window)
    if kind == "max":
        return F.max(expr).over(window)
    return F.last(expr, ignorenulls=True).over(window)


def running(
    df: DataFrame, order: Sequence[str], width: int = SLICE_US, keys: Sequence[str] = TRACK, drop: Sequence[str] = (), **runs: Run
) -> DataFrame:
    """Running values along each track in ``order`` (first entry is the slicing axis). Adds one column per run.

    ``drop`` names columns needed for the runs only. Rows without a track or a place have no position in any track and are left out.

    Reuses ``_s`` when the rows are sliced already, so no further shuffle of the rows is needed.
    """
    keys = list(keys)
    part = [*keys, "_s"]
    if "_s" not in df.columns:
        df = sliced(df, order[0], width)
    for name, run in runs.items():
        df = df.withColumn(f"_x_{name}", run.expr)
    df = df.drop(*drop)
    # one shuffle serves both the rows and the summaries: the summary names every column and both sides ask for a
    # known track and place, so neither is pruned or filtered differently and the exchange is reused
    for c in part:
        df = df.filter(F.col(c).isNotNull())
    df = df.repartition(*part)
    whole = F.bit_xor(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])).alias("_rows")

    local, totals, carries = df, [], []
    for name, run in runs.items():
        x = F.col(f"_x_{name}")
        ordering = [F.col(c).desc() if run.reverse else F.col(c).asc() for c in order]
        upto = Window.partitionBy(*part).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, 0 if run.inclusive else -1
        )
        local = local.withColumn(f"_l_{name}", _over(run.kind, x, upto))
        if run.kind == "last":
            key = F.when(x.isNotNull(), F.struct(*order))
            totals.append((F.min_by if run.reverse else F.max_by)(x, key).alias(f"_t_{name}"))
        else:
            totals.append((F.sum if run.kind == "sum" else F.max)(x).alias(f"_t_{name}"))
        slices = Window.partitionBy(*keys).orderBy(F.col("_s").desc() if run.reverse else F.col("_s").asc())
        before = slices.rowsBetween(Window.unboundedPreceding, -1)
        carries.append(_over(run.kind, F.col(f"_t_{name}"), before).alias(f"_c_{name}"))

    carry = df.groupBy(*part).agg(*totals, whole).filter("_rows is not null").select(*part, *carries)
    out = local.join(carry, part, "left")
    gone = ["_s"]
    for name, run in runs.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if run.kind == "sum":
            both = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        elif run.kind == "max":
            both = F.greatest(here, there)
        else:
            both = F.coalesce(here, there)
        out = out.withColumn(name, both)
        gone += [f"_x_{name}", f"_l_{name}", f"_c_{name}"]
    return out.drop(*gone)


def row_index(
    df: DataFrame, order: Sequence[str], width: int = SLICE_US, keys: Sequence[str] = TRACK, name: str = "rn"
) -> DataFrame:
    """Dense 0-based position of every row in its track."""
    out = running(df, order, width, keys, **{name: Run("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))


def row_halo(
    df: DataFrame, order: Sequence[str], before: int, after: int, width: int = SLICE_US,
    keys: Sequence[str] = TRACK, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Slices of exactly ``block`` rows with ``before``/``after`` neighbour rows, for ROWS frames and n-grams."""
    return halo(row_index(df, order, width, keys), "rn", block, before, after)


def group_gap(
    df: DataFrame, tol: int, t: str = "t_us", id: str = "cand_id", width: int = SLICE_US,
    keys: Sequence[str] = TRACK, strict: bool = False,
) -> DataFrame:
    """New group when the gap to the previous row exceeds ``tol`` (``strict``: reaches it).

    A group is named by its first row: ``grp_t``, ``grp_id``.
    """
    rows = halo(df, t, width, before=tol)
    w = slice_window(keys, t, id)
    gap = F.col(t) - F.lag(t).over(w)
    far = gap >= tol if strict else gap > tol
    rows = rows.withColumn("_start", F.coalesce(far, F.lit(True))).filter("_own").drop("_own")
    rows = running(
        rows, [t, id], width, keys, drop=["_start"],
        _g=Run("last", F.when(F.col("_start"), F.struct(F.col(t).alias("t"), F.col(id).alias("id")))),
    )
    return rows.withColumn("grp_t", F.col("_g.t")).withColumn("grp_id", F.col("_g.id")).drop("_g")


def anchor_times(
    df: DataFrame, tol: int, t: str = "t_us", width: int = SLICE_US, keys: Sequence[str] = TRACK,
    strict: bool = False,
) -> DataFrame:
    """Anchored groups over the distinct times of each track: (keys, t, anchor_t).

    A new group starts when the time is more than ``tol`` past the *first* time of the group, so group borders
    depend on earlier choices. Each slice is folded on its own. Where a slice touches the one before (no gap above
    ``tol`` between them), the incoming anchor matters only through the first row it lets in, so the slice is
    summarised as a short table from possible entry rows to the anchor that leaves it; chaining these tables
    over touching slices gives each slice its true incoming anchor.
    """
    keys = list(keys)
    width = max(width, 2 * tol + 1)
    part = [*keys, "_s"]

    def step(a: str, x: str) -> str:
        return f"({x} - {a} {'>=' if strict else '>'} {tol})"

    # times within reach of a border are also sent over it, so a slice knows by itself whether it touches its neighbours
    times = halo(df.select(*keys, F.col(t).alias("_t")), "_t", width, before=tol, after=tol)
    pieces = times.groupBy(*part).agg(F.array_sort(F.collect_set(F.when(F.col("_own"), F.col("_t")))).alias("ts"), *[
        f(F.when(~F.col("_own") & out, F.col("_t"))).alias(name)
        for f, out, name in ((F.max, F.col("_t") < F.col("_s") * width, "_before"), (F.min, F.col("_t") >= (F.col("_s") + 1) * width, "_after"))
    ]).filter("size(ts) > 0")
    apart = lambda a, b: F.expr(f"not coalesce({step(a, b)}, true)")
    pieces = pieces.withColumn("first", F.expr("ts[0]")).withColumn("linked", apart("_before", "first")).withColumn(
        "onward", apart("element_at(ts, -1)", "_after")).drop("_before", "_after")
    # only slices that touch a neighbour need a table of exits, and a place in their chain
    ends = pieces.filter("linked or onward")
    chains = Window.partitionBy(*keys).orderBy("_s")
    run = ends.select(*part, F.last(F.when(~F.col("linked"), F.col("_s")), True).over(chains).alias("run"))
    ends = ends.join(run, part)
    leave = f"aggregate(ts, {{e}}, (a, x) -> if({step('a', 'x')}, x, a))"
    entries = (
        f"transform(concat(filter(ts, y -> y <= first + {tol}), "
        f"slice(filter(ts, y -> y > first + {tol}), 1, 1)), e -> struct(e, {leave.format(e='e')} as x))"
    )
    ends = ends.select(
        *keys, "_s", "run", "linked", F.expr(f"if(linked, {entries}, null)").alias("entries"),
        F.expr(f"if(linked, null, {leave.format(e='first')})").alias("x0"),
    )
    chain = ends.groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.struct("_s", "linked", "entries", "x0"))).alias("chain")
    )
    enter = "try_element_at(filter(s.entries, n -> " + step("acc.a", "n.e") + "), 1).x"
    follow = (
        "aggregate(chain, struct(cast(null as bigint) as a, array(cast(null as bigint)) as seen), (acc, s) -> "
        f"if(s.linked, struct(coalesce({enter}, acc.a) as a, concat(acc.seen, array(acc.a)) as seen), "
        "struct(s.x0 as a, concat(acc.seen, array(cast(null as bigint))) as seen)))"
    )
    carry = chain.select(*keys, F.expr(f"inline(arrays_zip(chain, slice({follow}.seen, 2, size(chain))))").alias("c", "carry"))
    carry = carry.select(*keys, F.col("c._s").alias("_s"), "carry")
    fold = (
        "aggregate(ts, struct(carry as a, cast(array() as array<bigint>) as out), (acc, x) -> "
        f"if(acc.a is null or {step('acc.a', 'x')}, struct(x as a, concat(acc.out, array(x)) as out), "
        "struct(acc.a as a, concat(acc.out, array(acc.a)) as out))).out"
    )
    folded = pieces.join(carry, part, "left").select(*keys, "ts", F.expr(fold).alias("anchors"))
    return folded.select(*keys, F.expr("inline(arrays_zip(ts, anchors))").alias(t, "anchor_t"))


def group_anchored(
    df: DataFrame, tol: int, t: str = "t_us", width: int = SLICE_US, keys: Sequence[str] = TRACK, strict: bool = False
) -> DataFrame:
    """Rows with ``anchor_t``, the time of the first row of their anchored group."""
    return df.join(anchor_times(df, tol, t, width, keys, strict), [*keys, t])


def drift_runs(
    frames: DataFrame, tol: int, value: str = "midi", frame: str = "frame", width: int = BLOCK_ROWS,
    keys: Sequence[str] = TRACK, id_gap: int = 1,
) -> DataFrame:
    """Runs of consecutive frames staying within ``tol`` of the run's *first* value: (keys, frame, run_frame).

    Rows must be unique per frame. As for anchors, a slice that continues the one before is summarised by what it
    does to each of the ``2 tol + 1`` first values that could still be running when it begins.
    """
    keys = list(keys)
    part = [*keys, "_s"]
    rows = sliced(frames.select(*keys, F.col(frame).alias("f"), F.col(value).cast("bigint").alias("v")), "f", width)
    pieces = rows.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("ps"))
    null = "cast(null as bigint)"
    # state: a = first value of the run, r = its first frame (null while it is the incoming run), p = last frame
    fold = (
        "aggregate(ps, {init}, (acc, x) -> "
        f"if(acc.a is null or x.f - acc.p > {id_gap} or abs(x.v - acc.a) > {tol}, "
        "struct(x.v as a, x.f as r, x.f as p), struct(acc.a as a, acc.r as r, x.f as p)))"
    )
    fresh = f"struct({null} as a, {null} as r, {null} as p)"
    ends = pieces.select(
        *part,
        F.expr("ps[0].f").alias("first"), F.expr("element_at(ps, -1).f").alias("last"),
        F.expr(
            f"transform(sequence(ps[0].v - {tol}, ps[0].v + {tol}), e -> struct(e, "
            + fold.format(init=f"struct(e as a, {null} as r, ps[0].f - 1 as p)") + " as x))"
        ).alias("entries"),
        F.expr(fold.format(init=fresh)).alias("x0"),
    )
    track = Window.partitionBy(*keys).orderBy("_s")
    ends = ends.withColumn("linked", F.coalesce(F.col("first") - F.lag("last").over(track) <= id_gap, F.lit(False)))
    ends = ends.withColumn("chain_s", F.last(F.when(~F.col("linked"), F.col("_s")), True).over(track))
    ends = ends.withColumn("onward", F.coalesce(F.lead("linked").over(track), F.lit(False)))
    chain = ends.filter("linked or onward").groupBy(*keys, "chain_s").agg(
        F.array_sort(F.collect_list(F.struct("_s", "linked", "entries", "x0"))).alias("chain")
    )
    hit = "try_element_at(filter(s.entries, n -> n.e = acc.a), 1).x"
    follow = (
        f"aggregate(chain, struct({null} as a, {null} as r, array(struct({null} as a, {null} as r)) as seen), (acc, s) -> "
        f"if(s.linked, struct(coalesce({hit}.a, s.x0.a) as a, "
        f"case when {hit} is null then s.x0.r else coalesce({hit}.r, acc.r) end as r, "
        "concat(acc.seen, array(struct(acc.a as a, acc.r as r))) as seen), "
        f"struct(s.x0.a as a, s.x0.r as r, concat(acc.seen, array(struct({null} as a, {null} as r))) as seen)))"
    )
    carry = chain.select(
        *keys, F.expr(f"inline(arrays_zip(chain, slice({follow}.seen, 2, size(chain))))").alias("c", "carry")
    ).select(*keys, F.col("c._s").alias("_s"), "carry")
    out = (
        f"aggregate(ps, struct(carry.a as a, carry.r as r, if(carry.a is null, {null}, ps[0].f - 1) as p, "
        "cast(array() as array<bigint>) as out), (acc, x) -> "
        f"if(acc.a is null or x.f - acc.p > {id_gap} or abs(x.v - acc.a) > {tol}, "
        "struct(x.v as a, x.f as r, x.f as p, concat(acc.out, array(x.f)) as out), "
        "struct(acc.a as a, acc.r as r, x.f as p, concat(acc.out, array(acc.r)) as out))).out"
    )
    folded = pieces.join(carry, part, "left").select(*keys, "ps", F.expr(out).alias("runs"))
    zipped = folded.select(*keys, F.expr("inline(arrays_zip(ps, runs))").alias("q", "run_frame"))
    return zipped.select(*keys, F.col("q.f").alias(frame), "run_frame")


def interval_groups(
    df: DataFrame, start: str, end: str, id: str, gap: int = 0, keys: Sequence[str] = TRACK, width: int = SLICE_US,
    touching: bool = True,
) -> DataFrame:
    """Chains of intervals: a row joins the group while its start <= running maximum end + ``gap``.

    Adds ``grp_t``, ``grp_id`` (the first row of the group).
    """
    rows = running(df, [start, id], width, keys, _e=Run("max", F.col(end), inclusive=False))
    near = F.col(start) <= F.col("_e") + gap if touching else F.col(start) < F.col("_e") + gap
    mark = F.when(~F.coalesce(near, F.lit(False)), F.struct(F.col(start).alias("t"), F.col(id).alias("id")))
    rows = running(rows, [start, id], width, keys, drop=["_e"], _g=Run("last", mark))
    return rows.withColumn("grp_t", F.col("_g.t")).withColumn("grp_id", F.col("_g.id")).drop("_g")


def range_join(
    left: DataFrame, right: DataFrame, lt: str, rt: str, before: int, after: int, keys: Sequence[str] = TRACK,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``lt - before <= rt <= lt + after``: an equi-join on (keys, bucket), then the exact test.

    The right side is copied into the buckets its reach touches; AQE splits hot buckets.
    """
    size = max(before + after, 1)
    lb = left.withColumn("_b", slice_of(F.col(lt), size))
    rb = right.withColumn(
        "_b", F.explode(F.sequence(slice_of(F.col(rt) - after, size), slice_of(F.col(rt) + before, size)))
    )
    near = (F.col(rt) >= F.col(lt) - before) & (F.col(rt) <= F.col(lt) + after)
    if how == "inner":
        return lb.join(rb, [*keys, "_b"]).filter(near).drop("_b")
    renamed = rb.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, "_b") else F.col(c) for c in rb.columns])
    on = near
    for c in (*keys, "_b"):
        on = on & (lb[c] == renamed[f"_r_{c}"])
    return lb.join(renamed, on, how).drop("_b", *[f"_r_{c}" for c in (*keys, "_b")])


def group_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, width: float = 1_000_000, name: str = "quantile"
) -> DataFrame:
    """Exact interpolated quantile per group for groups of any size.

    Works on the histogram of distinct values with a running count, so no group is sorted or held in one task.
    """
    keys = list(keys)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    hist = hist.withColumn("_s", F.floor(F.col("_v") / F.lit(width)).cast("bigint"))
    hist = running(hist, ["_v"], keys=keys, _upto=Run("sum", F.col("_n")))
    total = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    at = (F.col("_total") - 1) * q
    low, high = F.floor(at), F.ceil(at)
    below = F.col("_upto") - F.col("_n")
    holds = lambda rank: (below <= rank) & (rank < F.col("_upto"))
    return hist.join(total, keys).filter(holds(low) | holds(high)).groupBy(*keys).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_hi"),
        F.first(at - low).alias("_f"),
    ).select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).cast("double").alias(name))
