"""Folds whose state cannot be tabulated: islands first, then slices of long islands one after the other.

An island starts where the state is known to reset. Most islands fit into one slice and are folded at once. A longer
one is cut into slices; round ``k`` folds the k-th slice of every island with the state its slice before left, so no
task holds more than a slice. Each round is checkpointed; there are as many as the longest island has slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dims import method_weight
from notelake.operators.timeline import SLICE_US, group_gap, interval_groups, range_join, sliced
from notelake.session import checkpointed


def fold_islands(rows: DataFrame, item: Sequence, state: str, fold: str, last: str, width: int = SLICE_US) -> DataFrame:
    """Rows with ``grp_t``, ``grp_id`` (island) and ``start_us`` folded in order of ``item`` (its columns, in sort order).

    ``state`` is the SQL type of the state, ``fold`` an expression over ``xs`` (items) and ``state`` giving
    struct(state, out array), ``last`` an expression over the final ``state`` giving an array to add at an island's end.
    """
    keys = ["track_id", "grp_t", "grp_id"]
    pieces = sliced(rows, "start_us", width).groupBy(*keys, "_s").agg(F.array_sort(F.collect_list(F.struct(*item))).alias("xs"))
    pieces = checkpointed(pieces)
    # number the slices of each island without carrying their rows along
    island = Window.partitionBy(*keys)
    places = pieces.select(*keys, "_s").withColumn("_r", F.row_number().over(island.orderBy("_s"))).withColumn("_n", F.count("*").over(island))
    pieces = pieces.join(places, [*keys, "_s"])
    rounds = pieces.agg(F.max("_r")).first()[0] or 0
    done, left = [], None
    for r in range(1, max(rounds, 1) + 1):
        now = pieces.filter(F.col("_r") == r)
        now = now.withColumn("state", F.expr(f"cast(null as {state})")) if left is None else now.join(left, keys)
        folded = checkpointed(now.select(*keys, (F.col("_r") == F.col("_n")).alias("ends"), F.expr(fold).alias("f")))
        done.append(folded.select("track_id", F.col("f.state").alias("state"), F.col("f.out").alias("out"), "ends").select(
            "track_id", F.expr(f"inline(if(ends, concat(out, {last}), out))")))
        left = folded.filter("not ends").select(*keys, F.col("f.state").alias("state"))
    return reduce(DataFrame.unionByName, done)


def dedupe_overlaps(notes: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Overlapping neighbours: the same pitch extends the note kept last, a surer one replaces it, others are dropped."""
    rows = notes.select("track_id", "note_id", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"), "midi", "confidence")
    rows = interval_groups(rows, "start_us", "end_us", "note_id", 0, width=width, touching=False)
    kind = "struct<s: bigint, id: bigint, e: bigint, m: int, c: double>"
    over = "(least(acc.state.e, x.e) - greatest(acc.state.s, x.s) > 0)"
    note = "named_struct('s', x.s, 'id', x.id, 'e', x.e, 'm', x.m, 'c', x.c)"
    longer = "named_struct('s', acc.state.s, 'id', acc.state.id, 'e', greatest(acc.state.e, x.e), 'm', acc.state.m, 'c', greatest(acc.state.c, x.c))"
    fold = (
        f"aggregate(xs, named_struct('state', state, 'out', cast(array() as array<{kind}>)), (acc, x) -> named_struct("
        f"'state', cast(case when acc.state is null then {note} when {over} and x.m = acc.state.m then {longer} "
        f"when {over} and x.c <= acc.state.c then acc.state else {note} end as {kind}), "
        f"'out', if(acc.state is null or {over}, acc.out, concat(acc.out, array(acc.state)))))"
    )
    item = [F.col("start_us").alias("s"), F.col("note_id").alias("id"), F.col("end_us").alias("e"), F.col("midi").cast("int").alias("m"), F.col("confidence").alias("c")]
    out = fold_islands(rows, item, kind, fold, "array(state)", width)
    return out.select("track_id", F.col("id").alias("note_id"), F.col("s").alias("start_us"), F.col("e").alias("end_us"), F.col("m").alias("midi"), F.col("c").alias("confidence"))


def consensus_notes(
    notes: DataFrame, tol_us: int = 50_000, semitones: int = 1, min_votes: int = 2, lone: float = 0.8,
    weights: Mapping[str, float] | None = None, width: int = SLICE_US,
) -> DataFrame:
    """Notes of several models clustered by nearness to any member of the running cluster, then averaged by weight.

    A cluster of one model's single note passes when its confidence is above ``lone``.
    """
    rows = group_gap(notes.select("track_id", "note_id", "start_us", "midi"), tol_us, "start_us", "note_id", width)
    near = f"exists(acc.state.r, q -> x.s - q.s <= {tol_us} and abs(x.m - q.m) <= {semitones})"
    kind = "struct<c: bigint, r: array<struct<s: bigint, m: int>>>"
    fits = f"(acc.state is not null and {near})"
    me = "array(named_struct('s', x.s, 'm', x.m))"
    fold = (
        "aggregate(xs, named_struct('state', state, 'out', cast(array() as array<struct<id: bigint, c: bigint>>)), (acc, x) -> named_struct("
        f"'state', cast(if({fits}, named_struct('c', acc.state.c, 'r', concat(filter(acc.state.r, q -> x.s - q.s <= {tol_us}), {me})), "
        f"named_struct('c', x.id, 'r', {me})) as {kind}), "
        f"'out', concat(acc.out, array(named_struct('id', x.id, 'c', if({fits}, acc.state.c, x.id))))))"
    )
    item = [F.col("start_us").alias("s"), F.col("note_id").alias("id"), F.col("midi").cast("int").alias("m")]
    member = fold_islands(rows, item, kind, fold, "cast(array() as array<struct<id: bigint, c: bigint>>)", width)
    joined = notes.join(member.select("track_id", F.col("id").alias("note_id"), F.col("c").alias("cluster")), ["track_id", "note_id"])
    w = method_weight(F.col("method"), weights) * F.col("confidence")
    end = F.col("start_us") + F.col("dur_us")
    out = joined.groupBy("track_id", "cluster").agg(
        F.count("*").alias("n"), F.size(F.collect_set("method")).alias("votes"), F.max("confidence").alias("confidence"),
        F.bround(F.sum(F.col("midi") * w) / F.sum(w)).cast("int").alias("midi"), (F.sum(F.col("start_us") * w) / F.sum(w)).alias("start_us"),
        (F.sum(end * w) / F.sum(w)).alias("end_us"))
    return out.filter((F.col("votes") >= min_votes) | ((F.col("n") == 1) & (F.col("confidence") > lone)))


def _short_groups(islands: DataFrame, tol_us: int, semitones: int) -> DataFrame:
    """(track_id, note_id, group) of islands of few notes, each folded at once in the order in which its notes come."""
    item = F.struct("rank", F.col("start_us").alias("s"), F.col("note_id").alias("id"), F.col("midi").alias("m"))
    near = f"filter(acc.r, q -> abs(x.s - q.s) <= {tol_us} and abs(x.m - q.m) <= {semitones})"
    fold = (
        "aggregate(xs, named_struct('r', cast(array() as array<struct<s: bigint, m: int, id: bigint>>), 'out', cast(array() as array<struct<id: bigint, g: bigint>>)), "
        f"(acc, x) -> transform(array(try_element_at({near}, 1).id), g -> named_struct("
        "'r', if(g is null, concat(acc.r, array(named_struct('s', x.s, 'm', x.m, 'id', x.id))), acc.r), "
        "'out', concat(acc.out, array(named_struct('id', x.id, 'g', coalesce(g, x.id))))))[0]).out"
    )
    pieces = islands.groupBy("track_id", "grp_t", "grp_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    return pieces.select("track_id", F.expr(f"inline({fold})").alias("note_id", "group"))


def agreement_groups(
    notes: DataFrame, order: Sequence[str], tol_us: int = 50_000, semitones: int = 1, width: int = SLICE_US, short: int = 256
) -> DataFrame:
    """(track_id, note_id, group): each note with the id of the group it joins, methods coming in ``order``, notes of a method in time order.

    A note joins the group found first whose first note is within ``tol_us`` and ``semitones``; where there is none it founds one. So a note founds a
    group just when no earlier founder is near. Founders of earlier methods are met by a range join; within a method only founders of the last
    ``tol_us`` matter, at most one for each pitch, so what is left is folded over islands of that method. Notes of methods not in ``order`` are left out.

    No note is near one of another island of all methods, so islands of up to ``short`` notes are folded at once; only longer ones, and those with ids
    or pitches that are missing or ids that come again, go method by method.
    """
    key = ["track_id", "note_id"]
    rows = notes.select(*key, "start_us", F.col("midi").cast("int").alias("midi"), "method")
    rows = rows.withColumn("rank", F.element_at(F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))]), F.col("method"))).filter("rank is not null")
    again = rows.groupBy(*key).agg(F.count("*").alias("_again")).filter("_again > 1")
    rows = group_gap(rows.drop("method").join(again, key, "left"), tol_us, "start_us", "note_id", width)
    rows = checkpointed(rows.withColumn("_odd", F.col("_again").isNotNull() | F.col("note_id").isNull() | F.col("midi").isNull()).drop("_again"))
    island = ["track_id", "grp_t", "grp_id"]
    sizes = rows.groupBy(*island).agg((F.max("_odd") | (F.count("*") > short)).alias("_long"))
    rows = rows.join(sizes, [rows[c].eqNullSafe(sizes[c]) if c == "grp_id" else rows[c] == sizes[c] for c in island]).select(rows["*"], "_long").drop("_odd")
    few = _short_groups(rows.filter("not _long"), tol_us, semitones)
    rows = checkpointed(rows.filter("_long").select(*key, "start_us", "midi", "rank"))
    if rows.isEmpty():
        return few
    founder = lambda df: df.select("track_id", F.col("note_id").alias("group"), F.col("start_us").alias("f_us"), F.col("midi").alias("f_midi"), F.col("rank").alias("f_rank"))

    def near(some: DataFrame, founders: DataFrame) -> DataFrame:
        return range_join(some, founder(founders), "start_us", "f_us", tol_us, tol_us).filter(F.abs(F.col("midi") - F.col("f_midi")) <= semitones)

    kind = "struct<r: array<struct<s: bigint, m: int>>>"
    free = f"not exists(coalesce(acc.state.r, array()), q -> x.s - q.s <= {tol_us} and abs(x.m - q.m) <= {semitones})"
    held = f"filter(coalesce(acc.state.r, cast(array() as array<struct<s: bigint, m: int>>)), q -> x.s - q.s <= {tol_us})"
    fold = (
        "aggregate(xs, named_struct('state', state, 'out', cast(array() as array<struct<id: bigint>>)), (acc, x) -> named_struct("
        f"'state', cast(named_struct('r', if({free}, concat({held}, array(named_struct('s', x.s, 'm', x.m))), {held})) as {kind}), "
        f"'out', if({free}, concat(acc.out, array(named_struct('id', x.id))), acc.out)))"
    )
    item = [F.col("start_us").alias("s"), F.col("note_id").alias("id"), F.col("midi").alias("m")]
    founders = rows.limit(0)
    for rank in range(len(order)):
        mine = rows.filter(F.col("rank") == rank)
        if rank:
            mine = mine.join(near(mine, founders).select(*key).distinct(), key, "left_anti")
        islands = group_gap(mine, tol_us, "start_us", "note_id", width)
        found = fold_islands(islands, item, kind, fold, "cast(array() as array<struct<id: bigint>>)", width)
        found = mine.join(found.select("track_id", F.col("id").alias("note_id")), key, "left_semi")
        founders = checkpointed(founders.unionByName(found))
    # only founders that were there when the note came
    place = F.struct("f_rank", "f_us", "group")
    joined = near(rows, founders).filter(place <= F.struct(F.col("rank").alias("f_rank"), F.col("start_us").alias("f_us"), F.col("note_id").alias("group")))
    return few.unionByName(joined.groupBy(*key).agg(F.min(place).getField("group").alias("group")))


def method_agreement(
    notes: DataFrame, order: Sequence[str], tol_us: int = 50_000, semitones: int = 1, width: int = SLICE_US
) -> DataFrame:
    """(track_id, group, start_us, midi, n_methods, methods): the groups of ``agreement_groups`` with the methods that agree on them, sorted and comma-joined."""
    groups = agreement_groups(notes, order, tol_us, semitones, width)
    members = groups.join(notes.select("track_id", "note_id", "method"), ["track_id", "note_id"]).groupBy("track_id", "group").agg(F.array_sort(F.collect_set("method")).alias("names"))
    first = notes.select("track_id", F.col("note_id").alias("group"), "start_us", "midi")
    return members.join(first, ["track_id", "group"]).select("track_id", "group", "start_us", "midi", F.size("names").alias("n_methods"), F.array_join("names", ", ").alias("methods"))


def agreement_counts(agreed: DataFrame) -> DataFrame:
    """How many groups of a track each number of methods agrees on."""
    return agreed.groupBy("track_id", "n_methods").agg(F.count("*").alias("n_groups"))
