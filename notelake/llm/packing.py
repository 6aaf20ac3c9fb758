"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Lengths are whole numbers from 1 to the capacity, so the whole corpus is described by a histogram of at most ``capacity``
rows, whatever its size. Best-two-fit runs once over that histogram in the driver and yields bin patterns with the number of
times each is used: fill a bin greedily with the largest lengths that fit, then replace its smallest document with two
unpacked ones that fit the expanded gap more tightly. A pattern repeats while its lengths last, which is what packing bin by
bin would do. The plan is made for several lengths up to which documents are saved as filler and the one with the fewest bins
is taken. The rows then find their place by their rank within their length: a distributed prefix count, and a join with the
table of patterns, whose size depends on the capacity only. So documents from all partitions share bins and no rows pass
through the driver.
"""

from __future__ import annotations

import bisect
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from notelake.llm.common import small_batches
from notelake.session import checkpointed

FLUSH = 4_000_000  # bytes of token ids in one output batch


class Encoder:
    """Token ids of the byte-level BPE vocabulary that the ``tokenizers`` file ``path`` holds.

    The same vocabulary as ranks (``<name>.tiktoken`` beside it) gives the same ids several times faster; texts that hold one
    of the special strings go to ``tokenizers`` itself, which maps these to their ids. Tests hold both against each other. Where
    there is no such rank file, ``tokenizers`` does all; a path to a rank file alone has no special strings.
    """

    def __init__(self, path: str):
        import base64
        import os
        import re

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow, self.full, self.special = None, None, None
        ranks_path = path if path.endswith(".tiktoken") else path.removesuffix(".json") + ".tiktoken"
        if path != ranks_path:
            self.slow = Tokenizer.from_file(path)
            self.special = re.compile("|".join(re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()) or r"(?!)")
        if not os.path.exists(ranks_path):
            return
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.full = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Without two blanks in a row the look-ahead of the pattern never decides, and without it the split is faster.
        plain = PATTERN.replace(r"\s+(?!\S)|", "")
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        self.blanks = re.compile(r"\s\s")

    def __call__(self, text: str) -> list[int]:
        if self.full is None or (self.special and self.special.search(text)):
            return self.slow.encode(text, add_special_tokens=False).ids
        return (self.full if self.blanks.search(text) else self.plain).encode_ordinary(text)


def tokenized_pieces(
    docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, piece (int, from 0), start, length and ids (little-endian unsigned 32-bit).

    A document's ids are those of its text followed by ``end_id``; null text is empty, so every row gives at least one id.
    Documents longer than ``capacity`` are cut into pieces of ``capacity`` ids, of which the first may be shorter. Repeated rows
    are cut each for itself, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            keys = batch.column(0)
            rows, held = ([], [], [], [], []), 0

            def flush():
                # ``take`` keeps the key column's own type
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                     pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py() or "")
                ids.append(end_id)
                data = memoryview(array("I", ids)).cast("B")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, v in zip(rows, (i, piece, a, b - a, bytes(data[4 * a:4 * b])), strict=True):
                        column.append(v)
                held += 4 * len(ids)
                if held > FLUSH:
                    yield flush()
                    rows, held = ([], [], [], [], []), 0
            if rows[0]:
                yield flush()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def fewest_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The best-two-fit plan with the fewest bins among those that save documents up to some length as filler for later bins."""
    plans = [best_two_fit(counts, capacity, filler) for filler in sorted({0, *(capacity // d for d in (64, 32, 16, 12, 8, 6, 5, 4))})]
    return min(plans, key=lambda bins: sum(times for _, times in bins))


def best_two_fit(counts: dict[int, int], capacity: int, filler: int = 0) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths from the start of the bin on) and how often each is used, for ``counts[length]`` documents.

    Documents of any length above ``filler`` replace others.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    if any(not 0 < size <= capacity for size in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    sizes = sorted(left)
    bins = []
    while sizes:
        used: Counter[int] = Counter()
        gap = capacity
        at = len(sizes)
        while gap:
            at = bisect.bisect_right(sizes, gap, 0, at)
            while at and left[sizes[at - 1]] <= used[sizes[at - 1]]:
                at -= 1
            if not at:
                break
            size = sizes[at - 1]
            n = min(gap // size, left[size] - used[size])
            used[size] += n
            gap -= n * size
        peak = Counter(used)
        while gap:
            smallest = min(size for size, n in used.items() if n)
            pair = _tightest_pair(sizes[bisect.bisect_right(sizes, filler):], left, used, smallest, gap + smallest)
            if not pair:
                break
            used[smallest] -= 1
            used.update(pair)
            gap += smallest - sum(pair)
            peak |= used
        used = +used
        # the same steps lead to the same bin as long as everything that was held on the way is there
        times = min((left[size] - peak[size]) // n + 1 for size, n in used.items())
        bins.append((sorted(used.elements(), reverse=True), times))
        for size, n in used.items():
            left[size] -= n * times
        sizes = [size for size in sizes if left[size]]
    return bins


def _tightest_pair(sizes: list[int], left: dict[int, int], used: Counter, above: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over ``above`` and not over ``room``; the more even pair among equals."""
    free = [s for s in sizes if s < room and left[s] > used[s]]
    best, low, high = None, 0, len(free) - 1
    while low <= high:
        total = free[low] + free[high]
        if total > room:
            high -= 1
        elif low == high and left[free[low]] - used[free[low]] < 2:
            break
        else:
            if total > above and (best is None or total >= sum(best)):
                best = (free[low], free[high])
            low += 1
    return best


def pattern_slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """For each length of each pattern: length, first and last rank + 1, documents a bin, first sequence, their offsets."""
    slots, taken, sequence = [], Counter(), 0
    for pattern, times in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for size in pattern:
            offsets.setdefault(size, []).append(at)
            at += size
        for size, places in offsets.items():
            n = len(places) * times
            slots.append((size, taken[size], taken[size] + n, len(places), sequence, places))
            taken[size] += n
        sequence += times
    return slots


def _ranked(pieces: DataFrame, rows: int, per_slice: int = 20_000) -> DataFrame:
    """Adds ``rank`` (from 0) within the length, counted over slices of about ``per_slice`` rows, so no length meets in one task."""
    slices = max(1, math.ceil(rows / per_slice))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "start")
    return sliced.withColumn("_row", F.row_number().over(place)).join(sizes, ["length", "_slice"]).withColumn(
        "rank", F.col("_before") + F.col("_row") - 1).drop("_slice", "_row", "_before")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with doc_id, piece, start and length (1 to ``capacity``).

    Pieces of one length are dealt out by doc_id, so equal input gives an equal packing; repeated rows are packed each. Further
    columns are kept, but they are stored with the pieces: drop token ids first and join them back where they are needed.
    Clashing columns ``sequence_id`` and ``offset`` are replaced. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = checkpointed(pieces.drop("sequence_id", "offset"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = pattern_slots(fewest_bins(counts, capacity))
    schema = "length long, _from long, _to long, _each long, _sequence long, _places array<long>"
    slots_df = F.broadcast(spark.createDataFrame(slots, schema))  # as many rows as the capacity allows patterns
    ranked = _ranked(pieces, sum(counts.values()))
    at = F.col("rank") - F.col("_from")
    return ranked.join(slots_df, (ranked["length"] == slots_df["length"]) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        F.get("_places", (at % F.col("_each")).cast("int")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces that carry ``ids``, put together: sequence_id, ids, and the doc_id and offset of every piece.

    A sequence holds at most the capacity in pieces, so a group is small.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"])).alias("pieces"),
    )
