"""Collocations: frequent phrases of up to five words, counted by double-array tries that are broadcast to all shards of the text.

Words and phrases are counted per language. The work goes level by level, after Apriori: a phrase of k words can be frequent only if its
first and its last k - 1 words are.

1. Words are counted; the frequent ones get dense numbers. Texts become arrays of these numbers, with 0 for a break between pieces or
   documents and for any word that is not frequent. The arrays are written once, the texts are not read again.
2. For k = 2, 3, ...: positions at which the phrase of k - 1 words there and the next one are frequent propose what stands there. Each
   shard hands in its distinct proposals with their evidence, cut off at the threshold (a sum of such evidence reaches the threshold just
   when the count does), so what reaches it in sum is a candidate. Nothing is paired that does not stand in a text.
3. Candidates become double-array tries over the digits of their words' numbers, in blocks of at most ``BLOCK`` phrases, so a broadcast is
   bounded whatever the corpus; more candidates mean more passes. Numpy advances the states of all positions of a shard at once,
   one level of the trie after the other, and bincounts the accepting states; the shards' counts are summed. The same pass notes
   how long a frequent phrase begins at each position, and what no frequent phrase covers is dropped before the next level.

Scores, cuts and the removal of phrases inside longer ones are joins over the counted phrases; products are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from notelake.llm.common import small_batches, stored

#: Phrases in one trie and words in one dictionary block.
BLOCK = 300_000
WORDS_IN_BLOCK = 500_000
DIGIT_BITS = 11
CHUNK = 1 << 18  # positions in one array
VECTOR = 4096  # phrases in one vector of counts
PROPOSED = 1 << 21  # positions that are reduced to distinct proposals at once
BREAK = b"."
#: Piece separators become the break, a tab becomes a blank.
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", BREAK * 10 + b" ")


def words_and_breaks(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered; ``BREAK`` stands between pieces and is never a word."""
    return raw.lower().translate(_TABLE).replace(BREAK, b" . ").split()


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) for every word; shards hand in partial counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                counts.pop(BREAK, None)
                words = list(counts)
                for k in range(0, len(words), 50_000):
                    part = words[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array([w.decode("utf-8", "replace") for w in part]), pa.array([counts[w] for w in part], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(name, Counter()).update(words_and_breaks(raw.as_py()))
            if sum(map(len, held.values())) > 400_000:
                yield from flush()
        yield from flush()

    return _texts(docs, text, lang).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a dense ``id`` from 0 on in ``order``, by key ranges and the number of rows of each range."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return stored(placed.join(F.broadcast(sizes), "_part").withColumn("id", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before"))


def _arrays(docs: DataFrame, words: DataFrame, n_words: int, text: str, lang: str) -> DataFrame:
    """(ids, longest): chunks of word numbers (int32, from 1) and of the length of the frequent phrase that begins at each (int8)."""
    spark = docs.sparkSession
    rows = _texts(docs, text, lang).withColumn("ids", F.lit(None).cast("binary"))
    blocks = range(0, max(n_words, 1), WORDS_IN_BLOCK)
    for low in blocks:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.filter((F.col("id") >= low) & (F.col("id") < low + WORDS_IN_BLOCK)).select("lang", "word", "id").collect():  # a block
            known.setdefault(r["lang"], {})[r["word"].encode()] = r["id"] + 1
        shared = spark.sparkContext.broadcast(known)

        def fill(batches: Iterator[pa.RecordBatch], last: bool = low == blocks[-1], shared=shared) -> Iterator[pa.RecordBatch]:
            parts, held = [], 0
            for batch in batches:
                out = []
                for name, raw, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tokens = words_and_breaks(raw)
                    get = shared.value.get(name, {}).get
                    found = np.fromiter((get(t, 0) for t in tokens), np.int32, len(tokens))
                    if ids is not None:
                        found += np.frombuffer(ids, np.int32)
                    if not last:
                        out.append(found.tobytes())
                        continue
                    parts += [found, np.zeros(1, np.int32)]
                    held += len(found) + 1
                    if held >= CHUNK:
                        yield _chunk(np.concatenate(parts))
                        parts, held = [], 0
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["lang", "text", "ids"])
            if parts:
                yield _chunk(np.concatenate(parts))

        final = low == blocks[-1]
        rows = stored(rows.mapInArrow(fill, "ids binary, longest binary" if final else "lang string, text binary, ids binary"))
    return rows


def _chunk(ids: np.ndarray, longest: np.ndarray | None = None) -> pa.RecordBatch:
    if longest is None:
        longest = (ids > 0).astype(np.int8)
    keep = (ids > 0) | np.append(True, ids[:-1] > 0)  # one break for a run of them
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[keep].tobytes()], pa.binary()), pa.array([longest[keep].tobytes()], pa.binary())], names=["ids", "longest"])


def _open_positions(ids: np.ndarray, longest: np.ndarray, k: int) -> np.ndarray:
    """Positions at which the first and the last k - 1 words of the phrase of k words are frequent."""
    return np.flatnonzero((longest[:-1] >= k - 1) & (longest[1:] >= k - 1)) if len(ids) > 1 else np.empty(0, np.int64)


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct row, how often it occurs)."""
    key = rows[:, 0].astype(np.int64)
    for column in rows.T[1:-1]:
        key = np.unique(key << 32 | column, return_inverse=True)[1]
    _, first, counts = np.unique(key << 32 | rows[:, -1], return_index=True, return_counts=True)
    return first, counts


def proposals(arrays: DataFrame, k: int, least: int) -> DataFrame:
    """(key, evidence) of phrases of ``k`` words that can be frequent; ``key`` holds the word numbers as big-endian 32-bit integers."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(found)
            first, counts = _distinct_rows(rows)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * k), len(first), [None, pa.py_buffer(rows[first].astype(">i4").tobytes())])
            return pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array(np.minimum(counts, least), pa.int64())], names=["key", "evidence"])

        for batch in batches:
            for ids, longest in zip(batch.column(0), batch.column(1), strict=True):
                ids, longest = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(longest.as_py(), np.int8)
                at = _open_positions(ids, longest, k)
                if len(at):
                    found.append(ids[at[:, None] + np.arange(k)])
                    held += len(at)
                if held >= PROPOSED:
                    yield flush()
                    found, held = [], 0
        if found:
            yield flush()

    return arrays.select("ids", "longest").mapInArrow(propose, "key binary, evidence long").groupBy("key").agg(F.sum("evidence").alias("evidence"))


class DoubleArray:
    """A trie of rows of word numbers as two arrays: state ``s`` goes by digit ``c`` to ``base[s] + c`` if ``check`` there is ``s``.

    A word number is read as ``digits`` digits of ``DIGIT_BITS`` bits, so that the alphabet is small and the arrays are dense. ``row`` tells
    which row an accepting state stands for.
    """

    def __init__(self, rows: np.ndarray, digits: int):
        self.digits = digits
        symbols = self.symbols(rows)
        depth = symbols.shape[1]
        alphabet = 1 << DIGIT_BITS
        new = np.zeros(symbols.shape, bool)  # whether a row begins a node of that depth
        new[0] = True
        changed = symbols[1:] != symbols[:-1]
        new[1:] = np.logical_or.accumulate(changed, axis=1)
        node = np.cumsum(new, axis=0) - 1
        parents, labels, firsts = [], [], []  # nodes of each depth: their parent, their symbol, the first row below
        for d in range(depth):
            first = np.flatnonzero(new[:, d])
            firsts.append(first)
            labels.append(symbols[first, d].astype(np.int64))
            parents.append(node[first, d - 1] if d else np.zeros(len(first), np.int64))
        jobs = []  # (children, depth, parent, begin): larger families find their place first
        for d in range(depth):
            begin = np.flatnonzero(np.append(True, parents[d][1:] != parents[d][:-1]))
            size = np.diff(np.append(begin, len(parents[d])))
            jobs.append(np.stack([size, np.full(len(begin), d), parents[d][begin], begin], axis=1))
        jobs = np.concatenate(jobs)
        jobs = jobs[np.argsort(-jobs[:, 0], kind="stable")]
        used = np.zeros(2 * alphabet + 2 * sum(map(len, labels)), bool)
        used[:alphabet] = True  # so that no base is negative; slot 0 is the root
        bases = [np.zeros(1 if d == 0 else len(labels[d - 1]), np.int64) for d in range(depth)]
        single = int(np.searchsorted(-jobs[:, 0], -1))
        cursor, width, misses = alphabet, 0, 0
        for size, d, parent, begin in jobs[:single].tolist():
            family = labels[d][begin:begin + size]
            if 2 * size < width or not width:
                cursor, width = alphabet, size
            while True:
                if cursor + 3 * alphabet > len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                free = cursor + np.flatnonzero(~used[cursor:cursor + 512])
                base = free[free >= family[0]] - family[0]
                fits = np.flatnonzero(~used[base[:, None] + family].any(axis=1)) if len(base) else base
                if len(fits):
                    break
                cursor += 512
            misses = misses + 1 if fits[0] > 256 else 0
            if misses > 64:
                cursor, misses = cursor + 128, 0
            used[base[fits[0]] + family] = True
            bases[d][parent] = base[fits[0]]
        lonely = jobs[single:]
        free = np.flatnonzero(~used)
        if len(free) < len(lonely):
            free = np.append(free, np.arange(len(used), len(used) + len(lonely)))
        free = free[:len(lonely)]
        for d in range(depth):
            mine = lonely[:, 1] == d
            bases[d][lonely[mine, 2]] = free[mine] - labels[d][lonely[mine, 3]]
        size = int(max(len(used), free[-1] + 1 if len(free) else 0)) + alphabet
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.row = np.full(size, -1, np.int32)
        slots = np.zeros(1, np.int64)
        for d in range(depth):
            self.base[slots] = bases[d]
            mine = bases[d][parents[d]] + labels[d]
            self.check[mine] = slots[parents[d]]
            slots = mine
        self.row[slots] = firsts[-1]

    def symbols(self, rows: np.ndarray) -> np.ndarray:
        shifts = DIGIT_BITS * np.arange(self.digits - 1, -1, -1)
        return (rows[:, :, None] >> shifts & (1 << DIGIT_BITS) - 1).reshape(len(rows), -1)

    def match(self, ids: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rows) of those of ``at`` where a phrase of ``words`` words of the trie begins; all states advance together."""
        state = np.zeros(len(at), np.int64)
        for k in range(words):
            word = ids[at + k].astype(np.int64)
            for digit in range(self.digits - 1, -1, -1):
                following = self.base[state] + (word >> DIGIT_BITS * digit & (1 << DIGIT_BITS) - 1)
                alive = self.check[following] == state
                state, at, word = following[alive], at[alive], word[alive]
        return at, self.row[state]


def _marked(arrays: DataFrame, phrases: np.ndarray, first_id: int, digits: int, k: int, end: bool) -> DataFrame:
    """One pass with one trie: the arrays with the phrases of ``k`` words noted, and rows (phrase, counts) with the shards' counts.

    A shard hands in its bincounts as vectors of ``VECTOR`` phrases from ``phrase`` on, not as a row per phrase.
    """
    shared = arrays.sparkSession.sparkContext.broadcast(DoubleArray(phrases, digits))
    size = len(phrases)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = shared.value, np.zeros(size, np.int64)
        for batch in batches:
            for ids, longest in zip(batch.column(0), batch.column(1), strict=True):
                ids, longest = np.frombuffer(ids.as_py(), np.int32), np.frombuffer(longest.as_py(), np.int8).copy()
                at, row = trie.match(ids, _open_positions(ids, longest, k), k)
                total += np.bincount(row, minlength=size)
                longest[at] = k
                if end:  # what no phrase of k words covers is of no use for longer ones
                    cover = np.zeros(len(ids) + 1, np.int64)
                    begins = np.flatnonzero(longest >= k)
                    np.add.at(cover, begins, 1)
                    np.add.at(cover, begins + k, -1)
                    ids = np.where(np.cumsum(cover)[:-1] > 0, ids, 0)
                    longest[ids == 0] = 0
                    if not ids.any():
                        continue
                out = _chunk(ids, longest)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=["ids", "longest", "phrase", "counts"])
        for low in range(0, size, VECTOR):
            part = total[low:low + VECTOR]
            if part.any():
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([low + first_id], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["ids", "longest", "phrase", "counts"])

    return stored(arrays.select("ids", "longest").mapInArrow(mark, "ids binary, longest binary, phrase long, counts binary"))


def _summed(shards: DataFrame) -> DataFrame:
    """(id, a) from the shards' vectors; those of the same phrases are streamed and added up, however many shards there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(total))), pa.array(total)], names=["id", "a"])

        for batch in batches:
            for phrase, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if phrase != at:
                    if total is not None:
                        yield out()
                    at, total = phrase, 0
                total = total + np.frombuffer(counts.as_py(), np.int64)
        if total is not None:
            yield out()

    rows = shards.filter("phrase is not null").select("phrase", "counts").repartition("phrase").sortWithinPartitions("phrase")
    return rows.mapInArrow(add, "id long, a long")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): (key, k, a) of every phrase of 1 to ``longest`` words that occurs ``least`` times in its language, (id, lang, word) of
    the frequent words, whose numbers (from 1) make up the keys, and (lang, n), the number of all word occurrences.
    """
    small_batches(docs.sparkSession)
    every = stored(word_counts(docs, text, lang))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _numbered(every.filter(F.col("n") >= least), "lang", "word")
    n_words = words.count()
    key = F.unhex(F.lpad(F.hex(F.col("id") + 1), 8, "0"))
    counted = [words.select(key.alias("key"), F.lit(1).alias("k"), F.col("n").alias("a"))]
    words = words.select((F.col("id") + 1).alias("id"), "lang", "word")
    digits = -(-max(n_words, 1).bit_length() // DIGIT_BITS)
    arrays = _arrays(docs, words.withColumn("id", F.col("id") - 1), n_words, text, lang)
    for k in range(2, longest + 1):
        candidates = _numbered(proposals(arrays, k, least).filter(F.col("evidence") >= least).select("key"), "key")
        n = candidates.count()
        if not n:
            break
        counts = []
        for low in range(0, n, BLOCK):
            block = candidates.filter((F.col("id") >= low) & (F.col("id") < low + BLOCK)).orderBy("id").select("key").toPandas()["key"]  # a block
            phrases = np.frombuffer(b"".join(block), ">i4").reshape(-1, k).astype(np.int64)
            passed = _marked(arrays, phrases, low, digits, k, low + BLOCK >= n)
            counts.append(_summed(passed))
            arrays = passed.filter("phrase is null").select("ids", "longest")
        level = counts[0]
        for more in counts[1:]:
            level = level.unionByName(more)
        counted.append(candidates.join(level, "id").select("key", F.lit(k).alias("k"), "a"))
    phrases = counted[0]
    for level in counted[1:]:
        phrases = phrases.unionByName(level)
    return stored(phrases.filter(F.col("a") >= least)), words, totals


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, percent: int = 100, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``first`` phrases of each language by score, count and phrase.

    A phrase of 2 to ``longest`` words with a count ``a`` of ``least`` or more is cut where floor(1000 * a * n / (l * r)) is smallest, at the first of
    equal cuts. Phrases whose words lie inside a longer candidate with ``percent`` percent of their count or more are dropped. Null texts are empty, a null
    language is ``und`` and joins rows of that name, texts of any length are read whole, repeated rows count each, other columns
    are ignored, an empty table gives an empty result. Ties go to the phrase that comes first in UTF-8 byte order.
    """
    phrases, words, totals = phrase_counts(docs, least, longest, text, lang)
    cands = phrases.filter("k > 1")
    inner = cands.filter("k > 2").select("key", "k", "a", F.explode(F.expr("sequence(2, k - 1)")).alias("len"))
    inner = inner.select("a", F.expr("explode(transform(sequence(0, k - len), i -> substring(key, 4 * i + 1, 4 * len)))").alias("key"))
    inner = inner.groupBy("key").agg(F.max("a").alias("inside"))
    kept = cands.join(inner, "key", "left").filter(~F.coalesce(100 * F.col("inside") >= percent * F.col("a"), F.lit(False))).drop("inside")

    cuts = kept.select("key", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 4 * cut)"), "right": F.expr("substring(key, 4 * cut + 1, 4 * (k - cut))")})
    count = lambda side, name: phrases.select(F.col("key").alias(side), F.col("a").alias(name))
    cuts = cuts.join(count("left", "l"), "left").join(count("right", "r"), "right")
    number = F.expr("conv(hex(substring(key, 4 * i + 1, 4)), 16, 10)").cast("long")
    spelled = kept.select("key", F.explode(F.expr("sequence(0, k - 1)")).alias("i")).withColumn("id", number).join(words, "id")
    spelled = spelled.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("i", "word"))).alias("at"), F.first("lang").alias("lang"))  # at most ``longest`` words
    spelled = spelled.select("key", "lang", F.array_join(F.transform("at", lambda x: x["word"]), " ").alias("phrase"))
    rows = cuts.join(spelled, "key").join(totals, "lang")
    wide = "decimal(38, 0)"
    rows = rows.withColumn("score", F.expr(f"cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide}) div (cast(l as {wide}) * cast(r as {wide}))"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = W.partitionBy("lang", "_part").orderBy(*order)
    best = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= first)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
