"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a language. A word's own evidence comes from hashed affixes, character n-grams and the word itself, and from
lexicons of words that are typical of a language; transitions between the languages of neighbouring words are learned with
them. Labels are read from forward-backward marginals over the whole text, so single loan words follow their surroundings and
code-switched passages keep their own language. A text's language is the one with the largest mean marginal, its score.

The model is trained on a bounded sample of labelled rows (``per_language`` texts each, ``window`` characters of each), cut into
sequences in which passages of different languages follow one another. Inference is exact over texts of any length: a text is
cut into blocks, each block's transfer matrix is computed side by side, the blocks are chained, and the marginals are then filled in
block by block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import small_batches

UNKNOWN = "und"
BUCKETS = 1 << 16
BLOCK = 64
LONGEST = 48  # longer runs of letters are read in parts of this length
CHUNK_WORDS = 120_000
CACHE_WORDS = 150_000
LEXICON_WORDS = 400

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    out = []
    for run in _RUN.findall(text.lower()):
        if not run.isalpha():  # number signs that count as word characters
            run = "".join(filter(str.isalpha, run))
            if not run:
                continue
        if len(run) <= LONGEST:
            out.append(run)
        else:
            out += [run[k:k + LONGEST] for k in range(0, len(run), LONGEST)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str], lexicons: list[set[str]]) -> np.ndarray:
    """Feature indices of each word, padded with ``BUCKETS + len(lexicons)`` (a row of zero weights)."""
    none = BUCKETS + len(lexicons)
    if not words:
        return np.full((0, 1), none, np.int64)
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    edged = np.zeros((len(words), width + 2), np.uint64)
    edged[:, 1:-1] = codes
    edged[:, 0] = 1
    rows = np.arange(len(words))
    edged[rows, lengths + 1] = 2
    out = []

    def add(hashed: np.ndarray, kind: int, valid: np.ndarray) -> None:
        at = (_mix(hashed * np.uint64(8) + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)
        out.append(np.where(valid, at, none))

    place = np.arange(width + 2)
    ends = (lengths + 2)[:, None]
    gram = edged
    for n in (2, 3):  # n-grams with word edges
        gram = _mix(gram[:, :width + 3 - n] * np.uint64(0x100000001B3) + edged[:, n - 1:])
        add(gram, n, place[:width + 3 - n] + n <= ends)
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for n in range(1, 5):  # affixes
        fits = lengths >= n
        head = _mix(head * np.uint64(0x100000001B3) + codes[:, min(n, width) - 1])
        tail = _mix(tail * np.uint64(0x100000001B3) + codes[rows, np.maximum(lengths - n, 0)])
        add(head[:, None] * np.uint64(5) + np.uint64(n), 4, fits[:, None])
        add(tail[:, None] * np.uint64(5) + np.uint64(n), 5, fits[:, None])
    whole = np.zeros(len(words), np.uint64)
    for k in range(width):
        whole = np.where(lengths > k, _mix(whole * np.uint64(0x100000001B3) + codes[:, k]), whole)
    add(whole[:, None], 6, np.ones((len(words), 1), bool))
    for k, lexicon in enumerate(lexicons):
        out.append(np.array([BUCKETS + k if w in lexicon else none for w in words], np.int64)[:, None])
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    labels: list[str]
    lexicons: list[set[str]]
    weights: np.ndarray  # (BUCKETS + lexicons + 1, labels), the last row zero
    transitions: np.ndarray  # (labels, labels), from row to column

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), np.float64)
        for a in range(0, len(words), 4096):
            part = features(words[a:a + 4096], self.lexicons)
            out[a:a + len(part)] = self.weights[part].sum(axis=1)
        return out


class ScoreCache:
    """Scores of words seen before, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.labels)))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(new)])
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def marginals(scores: np.ndarray, lengths: list[int], transitions: np.ndarray) -> np.ndarray:
    """P(label | text) of every word by forward-backward; ``scores`` holds the texts one after the other, none is empty."""
    if not len(scores):
        return scores
    n_labels = scores.shape[1]
    step = np.exp(transitions - transitions.max())
    sizes = np.asarray(lengths)
    blocks = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    total = int(blocks.sum())
    word_in_text = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first_block, sizes) * BLOCK + word_in_text
    e = np.ones((total * BLOCK, n_labels))
    e[at] = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = e.reshape(total, BLOCK, n_labels)
    real = np.zeros(total * BLOCK, bool)
    real[at] = True
    real = real.reshape(total, BLOCK)
    starts = np.zeros(total, bool)
    starts[first_block] = True

    # the transfer matrix of each block: entry state to exit state
    through = np.tile(np.eye(n_labels), (total, 1, 1))
    for k in range(BLOCK):
        moved = through @ step
        if k == 0:
            moved[starts] = through[starts]
        moved *= e[:, k, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        through = np.where(real[:, k, None, None], moved, through)
    # chain the blocks of each text, both ways
    enter = np.full((total, n_labels), 1.0)
    leave = np.full((total, n_labels), 1.0)
    for t in range(1, int(blocks.max())):
        here = first_block[blocks > t] + t
        v = np.einsum("bi,bij->bj", enter[here - 1], through[here - 1])
        enter[here] = v / v.max(axis=1, keepdims=True)
    for t in range(int(blocks.max()) - 2, -1, -1):
        here = first_block[blocks > t + 1] + t
        v = np.einsum("bij,bj->bi", through[here + 1], leave[here + 1])
        leave[here] = v / v.max(axis=1, keepdims=True)
    # fill the blocks in
    forward = np.empty((total, BLOCK, n_labels))
    v = enter
    for k in range(BLOCK):
        moved = v @ step
        if k == 0:
            moved[starts] = v[starts]
        moved = moved * e[:, k]
        moved /= moved.max(axis=1, keepdims=True)
        v = np.where(real[:, k, None], moved, v)
        forward[:, k] = v
    v = leave
    for k in range(BLOCK - 1, -1, -1):
        forward[:, k] *= v
        moved = (e[:, k] * v) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        v = np.where(real[:, k, None], moved, v)
    both = forward.reshape(-1, n_labels)[at]
    return both / both.sum(axis=1, keepdims=True)


def _lexicons(texts: list[tuple[str, list[str]]], labels: list[str]) -> list[set[str]]:
    """For each language the words most typical of it, by count times the log of how much likelier they are there."""
    counts = {label: Counter() for label in labels}
    for label, words in texts:
        counts[label].update(words)
    totals = {label: sum(c.values()) or 1 for label, c in counts.items()}
    everywhere = sum(counts.values(), Counter())
    out = []
    for label in labels:
        gain = {w: n * np.log(((n + 0.5) / totals[label]) / ((everywhere[w] + 0.5) / sum(totals.values()))) for w, n in counts[label].items() if n > 1}
        best = sorted(gain, key=lambda w: (-gain[w], w))[:LEXICON_WORDS]
        out.append({w for w in best if gain[w] > 0})
    return out


def _passages(texts: list[tuple[str, list[str]]], rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """Sequences of up to BLOCK words in which passages of one to three texts follow one another."""
    parts = []
    for label, words in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(6, 22))
            parts.append((label, words[at:at + n]))
            at += n
    rng.shuffle(parts)
    out, at = [], 0
    while at < len(parts):
        n = int(rng.integers(1, 4))
        chosen = parts[at:at + n]
        at += n
        out.append(([w for _, p in chosen for w in p], [label for label, p in chosen for _ in p]))
    return out


def fit(texts: list[tuple[str, str]], epochs: int = 3, rate: float = 0.25, decay: float = 1e-6, seed: int = 0) -> Model:
    """Train on (language, text) pairs by stochastic gradients (Adagrad) of the conditional log-likelihood."""
    rng = np.random.default_rng(seed)
    worded = [(label, words) for label, text in sorted(set(texts)) if (words := words_of(text))]
    labels = sorted({label for label, _ in worded})
    if not labels:
        return Model([], [], np.zeros((BUCKETS + 1, 0)), np.zeros((0, 0)))
    lexicons = _lexicons(worded, labels)
    n = len(labels)
    model = Model(labels, lexicons, np.zeros((BUCKETS + n + 1, n)), np.zeros((n, n)))
    number = {label: i for i, label in enumerate(labels)}
    power_w, power_t = np.full(model.weights.shape, 1e-2), np.full((n, n), 1e-2)
    for _ in range(epochs):
        sequences = _passages(worded, rng)
        for a in range(0, len(sequences), 64):
            batch = sequences[a:a + 64]
            words = [w for ws, _ in batch for w in ws]
            truth = np.array([number[label] for _, ls in batch for label in ls])
            lengths = [len(ws) for ws, _ in batch]
            index = features(words, lexicons)
            scores = model.weights[index].sum(axis=1)
            node = marginals(scores, lengths, model.transitions)
            pair = _expected_moves(scores, lengths, model.transitions)
            node[np.arange(len(truth)), truth] -= 1
            inner = np.ones(len(truth), bool)
            inner[np.cumsum(lengths) - lengths] = False
            np.subtract.at(pair, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
            touched, place = np.unique(index, return_inverse=True)
            place, width = place.ravel(), index.shape[1]
            g = np.stack([np.bincount(place, np.repeat(node[:, k], width), len(touched)) for k in range(n)], axis=1)
            g[touched == len(model.weights) - 1] = 0  # the padding stays at zero
            g = g / len(batch) + decay * model.weights[touched]
            power_w[touched] += g * g
            model.weights[touched] -= rate * g / np.sqrt(power_w[touched])
            g = pair / len(batch) + decay * model.transitions
            power_t += g * g
            model.transitions -= rate * g / np.sqrt(power_t)
    model.weights[-1] = 0
    model.weights = model.weights.astype(np.float32)
    return model


def _expected_moves(scores: np.ndarray, lengths: list[int], transitions: np.ndarray) -> np.ndarray:
    """Expected number of moves between labels; the sequences of a training batch are short and run side by side."""
    n, longest = scores.shape[1], max(lengths)
    e = np.ones((len(lengths), longest, n))
    real = np.arange(longest)[None, :] < np.array(lengths)[:, None]
    e[real] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0]
    for k in range(1, longest):
        v = (forward[:, k - 1] @ step) * e[:, k]
        forward[:, k] = v / v.max(axis=1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        v = (e[:, k + 1] * backward[:, k + 1]) @ step.T
        backward[:, k] = np.where(real[:, k + 1, None], v / v.max(axis=1, keepdims=True), 1.0)
    moves = forward[:, :-1, :, None] * step * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    moves /= moves.sum(axis=(2, 3), keepdims=True)
    return moves[real[:, 1:]].sum(axis=0)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 600, window: int = 600, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on about ``per_language`` rows of each language that are not held out, ``window`` characters of each text.

    The rows are chosen by a hash of the text, the window by the same hash. Rows without text or language are left out.
    """
    hashed = F.xxhash64(F.col(text))
    rows = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), hashed.alias("h"), F.length(text).alias("n"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return fit([])
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1_000_000 * min(1.0, 1.2 * per_language / n)) + 1))])
    chosen = rows.filter(F.pmod("h", F.lit(1_000_000)) < shares[F.col("lang")])
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.col("n") - window, F.lit(0)) + 1) + 1
    # copies of one text are all chosen or none: one of them is enough, so no group of copies fills the sample
    parts = chosen.select("lang", "h", F.substring("text", start.cast("int"), F.lit(window)).alias("text")).dropDuplicates(["lang", "h"])
    sample = parts.select("lang", "text").limit(4 * per_language * len(counts)).collect()
    return fit([(r["lang"], r["text"]) for r in sample])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of batches with about CHUNK_WORDS words, and the words of each text."""
    for batch in batches:
        begin, held, texts = 0, 0, []
        column = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            t = column[i].as_py()
            texts.append(words_of(t) if t else [])
            held += len(texts[-1])
            if held >= CHUNK_WORDS or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, held, texts = i + 1, 0, []


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the whole text only.

    ``und`` with score 0 where the text is null or has no letters, or where the model knows no language. Columns named like the
    results are replaced. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows of one number per language
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        cache = ScoreCache(crf)
        for batch, texts in _chunks(batches):
            found = [(UNKNOWN, 0.0)] * len(texts)
            full = [i for i, words in enumerate(texts) if words and crf.labels]
            if full:
                lengths = [len(texts[i]) for i in full]
                chance = marginals(cache([w for i in full for w in texts[i]]), lengths, crf.transitions)
                mean = np.add.reduceat(chance, np.cumsum(lengths) - lengths, axis=0) / np.array(lengths)[:, None]
                for i, row in zip(full, mean, strict=True):
                    best = int(row.argmax())
                    found[i] = (crf.labels[best], min(1.0, float(row[best])))
            kept = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    held = [F.col(f"`{c}`") for c in names]
    return docs.select(*held, F.col(text).cast("string").alias("_text_")).mapInArrow(label, schema)


def label_words(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and runs: the text's words cut where the language changes, as (lang, words, chance), in order."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType()), T.StructField("chance", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("runs", T.ArrayType(run))])
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("chance", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        cache = ScoreCache(crf)
        for batch, texts in _chunks(batches):
            out = []
            for words in texts:
                runs = []
                if words and crf.labels:
                    chance = marginals(cache(words), [len(words)], crf.transitions)
                    best = chance.argmax(axis=1)
                    cuts = np.flatnonzero(np.diff(best)) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
                        runs.append({"lang": crf.labels[best[a]], "words": int(b - a), "chance": float(chance[a:b, best[a]].mean())})
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text_")).mapInArrow(label, schema)


def identified(docs: DataFrame, least: float = 0.4, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, with their own columns."""
    model = train(docs, text=text, lang=lang, doc_id=doc_id)
    lead = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = predict(lead, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
