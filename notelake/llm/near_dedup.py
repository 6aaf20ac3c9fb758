"""Near-duplicate grouping with SuperMinHash: signatures, banding, verification on full shingle sets and union-find.

A document is its set of ``words``-word shingles, as 64-bit hashes. Documents with equal sets form one class, and only classes
are compared. A class gets a SuperMinHash signature: every shingle walks through its own pseudo-random permutation of the
positions and offers ``step + random`` at each; a step cannot improve on an earlier one, so the walk ends as soon as all
positions have a value. Signatures are cut into BANDS bands of ROWS positions; classes that agree in a band share a bucket. Two
sets with a similarity of 0.8 miss each other in all bands with a probability of about 1e-7, more similar ones still less.

Buckets are compared without listing their pairs. First each class meets the pivot of each of its buckets, and links that
hold on the full sets are grouped. A bucket whose members are all in one group is done. In the others, members outside the
bucket's largest group look for partners of other groups by exact prefix filtering, so no link inside a bucket is lost. Pairs whose
set sizes or signatures rule the similarity out are dropped before texts move.
Links are grouped by union-find inside partitions, then by label rounds with pointer jumping over the remaining forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from notelake.llm.common import join_groups, small_batches, stored
from notelake.llm.exact_dedup import filter_bits, flagged, positions_of

BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
#: Share of equal signature bytes under which a pair is not read: six standard deviations under 0.8 for 200 positions.
PLAUSIBLE = 0.62
CHUNK_SHINGLES, CHUNK_DOCS = 60_000, 400
CACHE_WORDS = 400_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)  # odd multipliers


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: WordHashes, words: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``; A-Z are lowered, ASCII white space separates words.

    A text with fewer words is one shingle, a text without words has none.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    out = np.full(len(h) - width + 1, width, np.uint64)  # the width parts short texts from shingles
    for k in range(width):
        out = scramble(out + h[k:len(h) - width + 1 + k]) * _MIX[k % len(_MIX)]
    return np.unique(scramble(out))


def superminhash(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """Signatures (one row of ``size`` doubles per set; none may be empty), all sets of the chunk step by step."""
    lengths = [len(s) for s in sets]
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    signature = np.full((len(sets), size), np.inf)
    flat = signature.reshape(-1)
    permutation = None
    rows = np.arange(len(elements))
    check = 1
    for step in range(size):
        bits = scramble(elements + np.uint64((step + 1) * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF))
        at = step + ((bits >> np.uint64(32)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        value = step + (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        if step == 0:
            position = at
        else:
            position = permutation[rows, at].astype(np.int64)
            permutation[rows, at] = permutation[rows, step]
        np.minimum.at(flat, owner * size + position, value)
        if step + 1 < check and step:
            continue
        check = max(check + 1, int(check * 1.25))
        # early stop: sets whose positions all have a value leave
        open_sets = np.isinf(signature).any(axis=1)
        if not open_sets.any():
            break
        keep = open_sets[owner]
        if step == 0:
            elements, owner, first = elements[keep], owner[keep], at[keep]
            rows = np.arange(len(elements))
            permutation = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
            permutation[rows, first] = 0
        elif not keep.all():
            elements, owner, permutation = elements[keep], owner[keep], permutation[keep]
            rows = np.arange(len(elements))
    return signature


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[1], (len(signature), 1))
    for k in range(parts.shape[2]):
        out = scramble(out ^ parts[:, :, k]) * _MIX[2]
    return scramble(out).view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    """A byte of every position, to estimate a similarity from."""
    return (scramble(np.ascontiguousarray(signature).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def signed(docs: DataFrame, words: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, tkey (hash of the text), n_shingles, cls (128-bit hash of the set), bands, sketch.

    ``cls``, ``bands`` and ``sketch`` are null for texts that are null or have no words.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("tkey", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, tkeys, texts = batch.columns

            def out(a: int, b: int, sets: list[np.ndarray]):
                held = [s for s in sets if len(s)]
                bands, sketch = np.empty((0, BANDS), np.int64), np.empty((0, SIZE), np.uint8)
                if held:
                    signature = superminhash(held)
                    bands, sketch = band_hashes(signature), _sketch(signature)
                at, classes, lists, sketches = 0, [], [], []
                for s in sets:
                    if len(s):
                        classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                        lists.append(bands[at])
                        sketches.append(sketch[at].tobytes())
                        at += 1
                    else:
                        for column in (classes, lists, sketches):
                            column.append(None)
                return pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), tkeys.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()),
                     pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=schema.names)

            begin, sets, held = 0, [], 0
            for i, value in enumerate(texts):
                sets.append(shingle_set(value.as_py() or b"", hashes, words))
                held += len(sets[-1])
                if held >= CHUNK_SHINGLES or len(sets) >= CHUNK_DOCS:
                    yield out(begin, i + 1, sets)
                    begin, sets, held = i + 1, [], 0
            if sets:
                yield out(begin, begin + len(sets), sets)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(sign, schema)


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures leave a similarity of 0.8 possible."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(axis=1) >= PLAUSIBLE))

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(close, "a binary, b binary")


def _verified(pairs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(), {}

        def shingles(cls: bytes, text: bytes) -> np.ndarray:
            if cls not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[cls] = shingle_set(text, hashes, words)
            return recent[cls]

        for batch in batches:
            hit = []
            for cls_a, cls_b, text_a, text_b in zip(*(batch.column(k) for k in range(4)), strict=True):
                a, b = shingles(cls_a.as_py(), text_a.as_py()), shingles(cls_b.as_py(), text_b.as_py())
                shared = len(a) + len(b) - len(np.union1d(a, b))
                hit.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a binary, b binary")


def _forest(links: DataFrame) -> DataFrame:
    """Links of each partition as trees of depth one: (a, b) with b the smallest of its tree."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        rows = [(x, root) for x in list(parent) if (root := find(x)) != x]
        for k in range(0, len(rows), 10_000):
            a, b = zip(*rows[k:k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(unite, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (a, b), label being the smallest id that it is connected to."""
    edges = stored(_forest(links).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "label")
        step = labels.withColumn("old", F.col("label")).unionByName(heard.withColumn("old", F.lit(None).cast("binary")))
        step = step.groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "old")
        step = stored(step)
        labels = step.select("id", "label")
        if step.filter("label != old").isEmpty():
            return labels


def _unfinished(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one group."""
    mixed = members.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low != _high").select("band")
    return members.join(mixed, "band", "left_semi")


def class_labels(signs: DataFrame, docs: DataFrame, words: int = 4, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(cls, label) of the classes that are linked to another class."""
    reps = signs.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = reps.select("cls", "n", F.explode("bands").alias("band"))
    in_bucket = W.partitionBy("band").orderBy("cls")
    rows = rows.withColumn("before", F.lag("n").over(in_bucket)).withColumn("after", F.lead("n").over(in_bucket))
    met = stored(rows.filter("before is not null or after is not null").select("band", "cls", "n"))
    # the pivot of a bucket is its member with the most company over all bands, which lies in the middle of its group
    company = met.groupBy("cls").agg(F.count("*").alias("company"))
    middle = W.partitionBy("band").orderBy(F.col("company").desc(), "cls")
    members = met.join(company, "cls")
    members = members.withColumn("pivot", F.first("cls").over(middle)).withColumn("pivot_n", F.first("n").over(middle))
    members = stored(members.select("band", "cls", "n", "pivot", "pivot_n"))
    fit = f"least(n, pivot_n) * 100 >= {percent} * greatest(n, pivot_n)"
    near = members.filter("cls != pivot").filter(fit)
    classes = _class_texts(signs, docs, members.select("cls").distinct(), text, doc_id)

    tested = stored(near.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct())
    links = stored(_verified(tested, classes, words, percent))
    labels = components(links)
    names = labels.withColumnRenamed("id", "cls")
    members = members.select("band", "cls", "n").join(names, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    members = stored(_unfinished(members))
    if members.isEmpty():
        return names
    pairs = stored(_plausible(_prefix_pairs(members, classes, words, percent).join(tested, ["a", "b"], "left_anti"), classes))
    links = stored(_verified(pairs, classes, words, percent))
    if links.isEmpty():
        return names
    # the groups of the first comparison are stars already, the later links join some of them
    ends = names.select(F.col("cls").alias("a"), F.col("label").alias("b")).filter("a != b")
    return components(ends.unionByName(links)).withColumnRenamed("id", "cls")


def _prefix_pairs(members: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different groups that may still be linked, found by exact prefix filtering.

    Sets of sizes n and m are linked only if they share t = percent * (n + m) / (100 + percent) shingles. With all shingles in
    one order, rarest first, they then share one among the first n - t + 1 of the one and the first m - t + 1 of the other. Of a
    pair in a bucket at least one member is outside the largest group of that bucket, so only such members seek partners. What
    sets them apart from the group are rare shingles, which come first, so a large group is not compared member by member.
    """
    sizes = members.groupBy("band", "label").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    buckets = sizes.groupBy("band").agg(F.max(F.struct("size", "label")).getField("label").alias("largest"), F.min("least").alias("least"))
    ids = members.join(buckets, "band").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("label").alias("label"), F.max(F.col("label") != F.col("largest")).alias("far"), F.min("least").alias("least"))
    ids = stored(ids.withColumn("least", F.greatest("least", F.ceil(percent * F.col("n") / 100))).withColumn("id", F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, parts, held = [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(parts).view(np.int64))], names=["id", "shingle"])

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(shingle_set(text.as_py(), hashes, words))
                keys.append(np.full(len(parts[-1]), key, np.int64))
                held += len(parts[-1])
                if held >= CHUNK_SHINGLES:
                    yield out()
                    keys, parts, held = [], [], 0
            if held:
                yield out()

    rows = classes.select("cls", "text").join(ids, "cls").select("id", "text").mapInArrow(explode, "id long, shingle long")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    rows = rows.join(shared, "shingle")  # shingles of one class only come first in its order, but find no partner
    by_class = W.partitionBy("id")
    rows = rows.withColumn("place", F.row_number().over(by_class.orderBy("df", "shingle"))).withColumn("kept", F.count("*").over(by_class))
    common = lambda n, m: F.ceil(percent * (n + m) / (100 + percent))
    rows = rows.join(ids, "id").withColumn("place", F.col("place") + F.col("n") - F.col("kept"))
    prefix = stored(rows.filter(F.col("place") <= F.col("n") - common(F.col("n"), F.col("least")) + 1).select("shingle", "cls", "n", "label", "far", "place"))
    u, v = prefix.filter("far").alias("u"), prefix.alias("v")
    t = common(F.col("u.n"), F.col("v.n"))
    meet = (F.col("u.shingle") == F.col("v.shingle")) & (F.col("u.label") != F.col("v.label"))
    fit = F.least("u.n", "v.n") * 100 >= percent * F.greatest("u.n", "v.n")
    reach = (F.col("u.place") <= F.col("u.n") - t + 1) & (F.col("v.place") <= F.col("v.n") - t + 1)
    pairs = u.join(v, meet & fit & reach)
    return pairs.select(F.greatest("u.cls", "v.cls").alias("a"), F.least("u.cls", "v.cls").alias("b")).distinct()


def _class_texts(signs: DataFrame, docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(cls, sketch, text) for the wanted classes, from one document of each; a bitmap keeps other texts out of the shuffle."""
    reps = signs.join(wanted, "cls").groupBy("cls").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("sketch").alias("sketch"))
    reps = stored(reps.select("cls", "sketch", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tkey").alias("tkey")))
    bits = filter_bits(reps.count())
    blocks = stored(positions_of(reps.select(F.col("tkey").alias("digest")), bits))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).cast("binary").alias("text"))
    rows = flagged(rows, blocks, bits).filter("maybe")
    met = rows.join(reps, (rows["digest"] == reps["tkey"]) & rows["_id"].eqNullSafe(reps["doc_id"]))
    return stored(met.select("cls", "sketch", "text").dropDuplicates(["cls"]))


def near_groups(docs: DataFrame, words: int = 4, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, cls, tkey and label for every row of ``docs``; other columns are ignored.

    ``component_id`` is the smallest id among the rows that links of ``percent`` percent similarity reach, the row itself
    included; null ids are passed over (a group without any id has a null one) and rows that repeat an id are kept or not
    together. ``label`` names the group itself, whatever the ids of its rows, and is null for rows that have no partner. Texts that are null or
    have no words are linked with nothing. Very long texts are read whole. An empty table gives an empty result.
    """
    signs = stored(signed(docs, words, text, doc_id))
    labels = class_labels(signs, docs, words, percent, text, doc_id)
    classes = signs.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("size"))
    classes = classes.join(labels, "cls", "left").filter("size > 1 or label is not null").withColumn("label", F.coalesce("label", "cls"))
    classes = stored(classes)
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = stored(classes.join(lowest, "label").select("cls", "component_id", "size", "label"))
    rows = join_groups(signs.select("doc_id", "n_shingles", "cls", "tkey"), classes, "cls", "size", signs.count())
    component = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cls", "tkey", "label")


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group stays: that with the smallest id (a row without an id only where no row has one), then the smallest
    text hash. Rows without a partner all stay, whatever ids they share with others. Rows equal in id and text count as one choice and stay or go
    together, so exact copies should be taken out before. The columns of ``docs`` are kept.
    """
    marked = stored(near_groups(docs, words, percent, text, doc_id).filter("label is not null").select("label", "doc_id", "tkey"))
    first = marked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("_id"), F.col("first.tkey").alias("_tkey"), F.lit(True).alias("_chosen"))
    gone = marked.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct()
    gone = gone.join(chosen.alias("c"), gone["_id"].eqNullSafe(F.col("c._id")) & (gone["_tkey"] == F.col("c._tkey")), "left_anti")
    rows = docs.withColumn("_key", F.xxhash64(F.col(text)))
    return rows.join(gone, rows[doc_id].eqNullSafe(gone["_id"]) & (rows["_key"] == gone["_tkey"]), "left_anti").select(*docs.columns)
