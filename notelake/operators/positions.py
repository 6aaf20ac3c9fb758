"""Strings, frets and hand positions; note lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.dims import NUM_FRETS, tuning_notes
from notelake.operators.theory import in_scale
from notelake.operators.timeline import SLICE_US, Run, previous, running, sliced

# Note and rest lengths in beats, in order of preference.
NOTE_VALUES = [
    ("whole", 4.0), ("half", 2.0), ("quarter", 1.0), ("eighth", 0.5), ("sixteenth", 0.25), ("thirty_second", 0.125),
    ("dotted_half", 3.0), ("dotted_quarter", 1.5), ("dotted_eighth", 0.75), ("quarter_triplet", 2 / 3), ("eighth_triplet", 1 / 3),
]
REST_VALUES = [("whole", 4.0), ("half", 2.0), ("quarter", 1.0), ("eighth", 0.5), ("sixteenth", 0.25)]


def in_range(midi: Column, tuning: str | Sequence[int], strict: bool, name: str) -> list[Column]:
    """Two columns: whether a pitch lies in the instrument's range, and the reason."""
    low = min(tuning_notes(tuning))
    high = low + 48
    if not strict:
        low, high = low - 2, high + 4
    reason = F.when(midi < low, "below lowest string" if strict else "too low").when(
        midi > high, "above highest fret" if strict else "too high").otherwise("valid")
    return [midi.between(low, high).alias(name), reason.alias(f"{name}_reason")]


def note_value(beats: Column) -> Column:
    """struct(value, error): the note length with the smallest relative error, first of equals."""
    options = [F.struct((F.abs(beats - b) / b).alias("error"), F.lit(i).alias("o"), F.lit(n).alias("value")) for i, (n, b) in enumerate(NOTE_VALUES)]
    best = F.least(*options)
    return F.struct(best["value"].alias("value"), best["error"].alias("error"))


def rest_value(beats: Column) -> Column:
    """struct(value, remaining): the longest rest that fits with 20 % tolerance."""
    out = F.struct(F.lit("sixteenth").alias("value"), F.lit(0.0).alias("remaining"))
    for n, b in reversed(REST_VALUES):
        out = F.when(beats >= b * 0.8, F.struct(F.lit(n).alias("value"), F.greatest(F.lit(0.0), beats - b).alias("remaining"))).otherwise(out)
    return out


def fold_to_range(midi: Column, low: int, high: int) -> Column:
    """Octave shifts up to ``low``, then down to ``high``, then a clamp."""
    up = F.when(midi < low, midi + 12 * F.ceil((F.lit(low) - midi) / 12)).otherwise(midi)
    down = F.when(up > high, up - 12 * F.ceil((up - high) / 12)).otherwise(up)
    return F.greatest(F.lit(low), F.least(F.lit(high), down)).cast("int")


def options_array(midi: Column, tuning: str | Sequence[int] = "standard") -> Column:
    """All playable (string, fret) of a pitch, low string first: at most one per string."""
    each = F.array(*[F.struct(F.lit(s).alias("string"), (midi - m).cast("int").alias("fret")) for s, m in enumerate(tuning_notes(tuning))])
    return F.filter(each, lambda o: o["fret"].between(0, NUM_FRETS))


def fret_options(notes: DataFrame, tuning: str | Sequence[int] = "standard") -> DataFrame:
    return notes.withColumn("o", F.explode(options_array(F.col("midi"), tuning))).withColumn("string", F.col("o.string")).withColumn(
        "fret", F.col("o.fret")).drop("o")


def static_position(notes: DataFrame, tuning: str | Sequence[int] = "standard") -> DataFrame:
    """Context-free position: low frets and middle strings, first of equals; unplayable notes are dropped."""
    score = lambda o: o["fret"] * 0.5 + F.abs(o["string"] - 2.5) * 0.3
    ranked = F.transform(options_array(F.col("midi"), tuning), lambda o: F.struct(score(o).alias("score"), o["string"].alias("string"), o["fret"].alias("fret")))
    return notes.withColumn("o", F.array_min(ranked)).filter("o is not null").withColumn("string", F.col("o.string")).withColumn(
        "fret", F.col("o.fret")).drop("o")


def hand_position(fret: Column) -> Column:
    return F.when(fret == 0, 0).when(fret <= 4, 1).when(fret <= 7, 5).when(fret <= 11, 9).otherwise(12)


def fret_base(fret: Column) -> Column:
    """First fret of the four-fret block."""
    return F.greatest(F.lit(1), (F.floor((fret - 1) / 4) * 4 + 1)).cast("int")


def _score_sql(policy: str, at: str) -> str:
    """Score of an option ``o`` after position ``at`` (struct string, fret; null before the first note)."""
    base = (
        "(case when o.fret <= 5 then 3D when o.fret <= 12 then 1D else 0D end) - o.fret * 0.2D"
        " + element_at(array(0.5D, 0.8D, 1.0D, 1.0D, 0.8D, 0.5D), o.string + 1) * 3"
    )
    jump, cross = f"abs(o.fret - {at}.fret)", f"abs(o.string - {at}.string)"
    if policy == "basic":
        near = f"(case when {jump} > 4 then {jump} * 0.5D else {jump} * 0.2D end) - {cross} * 0.8D"
    elif policy == "heuristic":
        near = f"{jump} * 0.3D - {cross} * 0.5D"
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return f"case when {at}.string is null then {base} else {base} - {near} end"


def assign_positions(
    notes: DataFrame, policy: str = "basic", tuning: str | Sequence[int] = "standard", width: int = SLICE_US
) -> DataFrame:
    """(string, fret) per note, in time order, each choice scored against the position *chosen* for the note before.

    A slice of a track depends on what comes before only through the last position, one of at most six. Each slice
    is folded once per possible entry; where all entries leave by the same position (nearly always), the next
    slice's entry is known, and only unbroken stretches of undecided slices are chained.
    """
    part = ["track_id", "_s"]
    rows = sliced(notes, "start_us", width).withColumn("opts", options_array(F.col("midi"), tuning)).filter("size(opts) > 0")
    pieces = rows.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("start_us", "note_id", "opts"))).alias("ns"))
    none = "cast(null as struct<string: int, fret: int>)"
    ranked = f"array_max(transform(x.opts, o -> struct({_score_sql(policy, 'acc')} as score, o.string as string, o.fret as fret)))"
    chosen = "if(size(x.opts) = 1, x.opts[0], " + f"transform(array({ranked}), b -> struct(b.string as string, b.fret as fret))[0])"
    leave = f"aggregate(ns, {{init}}, (acc, x) -> {chosen})"
    track = Window.partitionBy("track_id").orderBy("_s")
    # possible entries are the last note's options of the slice before; only those travel along the track
    enter = pieces.select(*part, F.expr("element_at(ns, -1).opts").alias("last_opts")).withColumn("enter", F.lag("last_opts").over(track))
    ends = pieces.join(enter.select(*part, "enter"), part)
    ends = ends.select(
        *part, F.expr(f"transform(enter, e -> struct(e, {leave.format(init='e')} as x))").alias("entries"),
        F.when(F.col("enter").isNull(), F.expr(leave.format(init=none))).alias("x0"),
    )
    ends = ends.withColumn("out", F.coalesce("x0", F.expr("if(size(array_distinct(entries.x)) = 1, entries[0].x, null)")))
    # a run begins after a slice with a known exit
    ends = ends.withColumn("before", F.lag("out").over(track)).withColumn("first", F.lag("_s").over(track).isNull())
    ends = ends.withColumn("run", F.last(F.when(F.col("before").isNotNull() | F.col("first"), F.col("_s")), True).over(track))
    chain = ends.groupBy("track_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("_s", "before", "out", "entries"))).alias("chain"))
    follow = (
        f"aggregate(chain, struct({none} as a, array({none}) as seen), (acc, s) -> "
        "struct(coalesce(s.out, element_at(filter(s.entries, n -> n.e = coalesce(s.before, acc.a)), 1).x) as a, "
        "concat(acc.seen, array(coalesce(s.before, acc.a))) as seen))"
    ).replace("element_at(filter", "try_element_at(filter")
    carry = chain.select("track_id", F.expr(f"inline(arrays_zip(chain, slice({follow}.seen, 2, size(chain))))").alias("c", "carry"))
    carry = carry.select("track_id", F.col("c._s").alias("_s"), "carry")
    out_chosen = chosen.replace("acc.", "acc.p.")
    fold = (
        "aggregate(ns, struct(carry as p, cast(array() as array<struct<string: int, fret: int>>) as out), (acc, x) -> "
        f"transform(array({out_chosen}), c -> struct(c as p, concat(acc.out, array(c)) as out))[0]).out"
    )
    folded = pieces.join(carry, part, "left").select("track_id", "ns", F.expr(fold).alias("ps"))
    placed = folded.select("track_id", F.expr("inline(arrays_zip(ns, ps))").alias("n", "p")).select(
        "track_id", F.col("n.note_id").alias("note_id"), "p.string", "p.fret")
    return notes.join(placed, ["track_id", "note_id"])


def compare_assignments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per track: notes both place alike, differently, or only one of them places."""
    l = a.select("track_id", "note_id", F.struct("string", "fret").alias("pa"))
    r = b.select("track_id", "note_id", F.struct("string", "fret").alias("pb"))
    rows = l.join(r, ["track_id", "note_id"], "full")
    return rows.groupBy("track_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("pa") == F.col("pb")).alias("agree"), F.count_if(F.col("pa") != F.col("pb")).alias("differ"),
        F.count_if(F.col("pa").isNull() | F.col("pb").isNull()).alias("one_sided"))


def assignment_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per note that two assignments place differently: both positions, and ``side`` (a or b) where only that one has one."""
    keys = ["track_id", "note_id"]
    l = a.select(*keys, F.col("string").alias("a_string"), F.col("fret").alias("a_fret"))
    r = b.select(*keys, F.col("string").alias("b_string"), F.col("fret").alias("b_fret"))
    rows = l.join(r, keys, "full")
    same = (F.col("a_string") == F.col("b_string")) & (F.col("a_fret") == F.col("b_fret"))
    side = F.when(F.col("b_string").isNull(), "a").when(F.col("a_string").isNull(), "b")
    return rows.filter(~F.coalesce(same, F.lit(False))).withColumn("side", side)


def compare_note_runs(a: DataFrame, b: DataFrame, keys: DataFrame) -> DataFrame:
    """Per track of either run: number of notes, lowest and highest pitch, mean confidence and notes outside the scale of the track's key.

    ``keys``: (track_id, root, mode), major or natural minor; tracks without a key have null counts outside.
    """
    def stats(notes: DataFrame, p: str) -> DataFrame:
        rows = notes.select("track_id", "midi", "confidence").join(keys.select("track_id", "root", "mode"), "track_id", "left")
        fits = F.when(F.col("mode") == "major", in_scale(F.col("midi"), F.col("root"), "major")).otherwise(in_scale(F.col("midi"), F.col("root"), "natural_minor"))
        outside = F.sum(F.when(F.col("root").isNotNull(), (~fits).cast("bigint")))
        return rows.groupBy("track_id").agg(
            F.count("*").alias(f"{p}_n"), F.min("midi").alias(f"{p}_low"), F.max("midi").alias(f"{p}_high"), F.avg("confidence").alias(f"{p}_confidence"), outside.alias(f"{p}_outside"))

    return stats(a, "a").join(stats(b, "b"), "track_id", "full")


def fingering_stats(tabs: DataFrame, width: int = SLICE_US) -> DataFrame:
    rows = running(tabs, ["start_us", "note_id"], width, prev=previous("string", "fret"))
    jump = F.when((F.col("fret") > 0) & (F.col("prev.fret") > 0), F.abs(F.col("fret") - F.col("prev.fret")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy("track_id").agg(
        zero(F.avg(F.when(F.col("fret") > 0, F.col("fret")))).alias("avg_fret"), F.max("fret").alias("max_fret"),
        F.count_if(F.col("fret") == 0).alias("open_strings"), zero(F.avg(jump)).alias("avg_fret_jump"), zero(F.max(jump)).alias("max_fret_jump"),
        zero(F.avg(F.abs(F.col("string") - F.col("prev.string")))).alias("avg_string_jump"))


def compare_fingerings(a: DataFrame, b: DataFrame, width: int = SLICE_US) -> DataFrame:
    l, r = fingering_stats(a, width), fingering_stats(b, width)
    names = [c for c in l.columns if c != "track_id"]
    l = l.select("track_id", *[F.col(c).alias(f"a_{c}") for c in names])
    r = r.select("track_id", *[F.col(c).alias(f"b_{c}") for c in names])
    both = l.join(r, "track_id", "full")
    return both.select("*", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"gain_{c}") for c in names])


def position_usage(tabs: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Four-fret blocks used, the main one, shifts of a block or more, and fret jumps over fretted notes."""
    fretted = tabs.filter("fret > 0").withColumn("base", fret_base(F.col("fret")))
    rows = running(fretted, ["start_us", "note_id"], width, prev=previous("fret", "base"))
    jump = F.abs(F.col("fret") - F.col("prev.fret"))
    stats = rows.groupBy("track_id").agg(
        F.count("*").alias("fretted"), F.count_if(F.abs(F.col("base") - F.col("prev.base")) >= 4).alias("shifts"), F.avg("fret").alias("avg_fret"),
        F.max("fret").alias("max_fret"), F.min("fret").alias("min_fret"), F.coalesce(F.avg(jump), F.lit(0.0)).alias("avg_jump"),
        F.coalesce(F.max(jump), F.lit(0)).alias("max_jump"))
    blocks = fretted.groupBy("track_id", "base").agg(F.count("*").alias("n"), F.min(F.struct("start_us", "note_id")).alias("seen"))
    main = blocks.groupBy("track_id").agg(
        F.min_by("base", F.struct(-F.col("n"), F.col("seen"))).alias("main_base"), F.count("*").alias("n_blocks"))
    return stats.join(main, "track_id")


def playable_transitions(tabs: DataFrame, max_jump: int = 5, min_us: int = 50_000, width: int = SLICE_US) -> DataFrame:
    """Each note with whether the hand can get there from the note before; open strings always can."""
    rows = running(tabs, ["start_us", "note_id"], width, prev=previous("start_us", "fret"))
    gap, jump = F.col("start_us") - F.col("prev.start_us"), F.abs(F.col("fret") - F.col("prev.fret"))
    free = F.col("prev").isNull() | (F.col("fret") == 0) | (F.col("prev.fret") == 0)
    bad = ((gap < min_us) & (jump > max_jump)) | ((jump > 12) & (gap < 100_000))
    return rows.withColumn("playable", free | ~bad).drop("prev")


def infer_hand_position(notes: DataFrame, first: int = 8, tuning: str | Sequence[int] = "standard") -> DataFrame:
    """Starting block of frets from all options of the first notes; root is the commonest pitch class of the first eight."""
    w = Window.partitionBy("track_id").orderBy("start_us", "note_id")
    head = notes.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= max(first, 8))
    options = fret_options(head.filter(F.col("pos") <= first), tuning).filter("fret > 0").withColumn(
        "base", F.greatest(F.lit(1), F.floor(F.col("fret") / 4) * 4).cast("int"))
    seen = F.min(F.struct("pos", "string"))
    base = options.groupBy("track_id", "base").agg(F.count("*").alias("n"), seen.alias("seen")).groupBy("track_id").agg(
        F.min_by("base", F.struct(-F.col("n"), F.col("seen"))).alias("base"))
    root = head.filter("pos <= 8").groupBy("track_id", F.pmod("midi", F.lit(12)).alias("pc")).agg(F.count("*").alias("n"), F.min("pos").alias("seen")).groupBy(
        "track_id").agg(F.min_by("pc", F.struct(-F.col("n"), F.col("seen"))).alias("root"))
    span = fret_options(head.filter(F.col("pos") <= first), tuning).join(base, "track_id").filter("fret between base and base + 4").groupBy("track_id").agg(
        (F.max("fret") - F.min("fret")).alias("span"))
    kind = F.when(F.col("span") <= 3, "pentatonic_box").when(F.col("span") <= 5, "three_per_string").otherwise("generic")
    return root.join(base, "track_id", "left").join(span, "track_id", "left").select(
        "track_id", F.coalesce("base", F.lit(0)).alias("base"), "root", F.when(F.col("base").isNull(), "open").otherwise(kind).alias("pattern"))


def position_asof(notes: DataFrame, positions: DataFrame, width: int = SLICE_US) -> DataFrame:
    """Last (track_id, t_us, base) at or before each note: union, then the last position seen."""
    marks = positions.select("track_id", F.col("t_us").alias("start_us"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("note_id"), "base")
    rows = notes.select("track_id", "start_us", F.lit(1).alias("side"), "note_id", F.lit(None).cast("int").alias("base")).unionByName(marks)
    out = running(rows, ["start_us", "side", "note_id"], width, held=Run("last", F.col("base")))
    return out.filter("side = 1").select("track_id", "note_id", "start_us", F.col("held").alias("base"))
