"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context, and that reply alone under the loss mask. Turns
behind the last assistant turn belong to no reply; they go into one closing example without a target, so the formatted output
holds the whole conversation and can be read back.

Template of a turn: ``### role: text </turn>`` and a line break. Inside texts and roles a backslash is put before every
backslash, before ``###`` and before ``</turn>`` (in roles also before ``:``), which is undone by dropping it again.

A conversation of n turns has examples of about n * n / 4 turns in all, so a long one is spread: its targets are cut into
slices of TARGETS turns, each slice gets the turns up to its end and streams through one task, which holds the conversation's
text so far and one batch of examples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from notelake.llm.common import small_batches, text_or_empty

TARGETS = 64
BATCH_CHARS = 4_000_000

_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    head = "### " + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + " </turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; anything but a whole sequence of turns is an error."""
    turns, at = [], 0
    for match in _TURN.finditer(formatted):
        if match.start() != at or not match[2].endswith(" "):
            break
        turns.append((unescape(match[1]), unescape(match[2].removesuffix(" "))))
        at = match.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def examples(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, example (int, from 0), is_last, text, loss_start and loss_end (code points; null in a closing example).

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by turn (null first), then role and text, so repeated
    turns have a defined place and are all kept. Null roles and texts are empty. A null conv_id is a conversation of its own.
    Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    whole = W.partitionBy("conv_id")
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy(*order)) - 1)
    ends = rows.groupBy("conv_id").agg((F.max("place")).alias("end")).withColumnRenamed("conv_id", "_conv")
    rows = rows.join(ends, rows["conv_id"].eqNullSafe(ends["_conv"])).drop("_conv")
    rows = rows.withColumn("slice", F.explode(F.sequence(F.floor(F.col("place") / TARGETS), F.floor(F.col("end") / TARGETS))))
    rows = rows.repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", "place")
    rows = rows.select("conv_id", "slice", "place", "end", "role", "text")
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("is_last", T.BooleanType()),
        T.StructField("text", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prefix, size = None, [], 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            keys = batch.column(0)

            def flush():
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                     pa.array(out[3], pa.string()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64())], names=schema.names)

            columns = [batch.column(k).to_pylist() for k in range(6)]
            for i, (conv, part, place, end, role, text) in enumerate(zip(*columns, strict=True)):
                if (conv, part) != current:
                    current, prefix, size = (conv, part), [], 0
                formatted, a, b = format_turn(role, text)
                prefix.append(formatted)
                start, size = size, size + len(formatted)
                target = role == assistant
                if place // TARGETS != part or not (target or place == end):
                    continue
                whole_text = "".join(prefix)
                prefix = [whole_text]
                values = (i, place, place == end, whole_text, start + a if target else None, start + b if target else None)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
                held += len(whole_text)
                if held > BATCH_CHARS:
                    yield flush()
                    out, held = ([], [], [], [], [], []), 0
            if out[0]:
                yield flush()

    made = rows.mapInArrow(expand, schema)
    number = F.row_number().over(whole.orderBy("place")) - 1
    return made.withColumn("example", number).select("conv_id", "example", "is_last", "text", "loss_start", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted examples hold, one row per conversation.

    conv_id, n_turns and turns_sha256 (of role, line break, text, line break for every turn) from the example with all turns;
    loss_chars and loss_sha256 of the unescaped texts under the loss masks in the order of the examples; formatted_chars, the
    length of all examples; n_examples. Examples are taken apart where they lie, only targets and digests are shuffled.
    """
    kind = formatted.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("example", T.LongType()), T.StructField("chars", T.LongType()),
        T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss", T.StringType())])

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for last, text, a, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                n, digest = None, None
                if last:
                    turns, sha = parse(text), hashlib.sha256()
                    for role, said in turns:
                        sha.update(f"{role}\n{said}\n".encode())
                    n, digest = len(turns), sha.hexdigest()
                for column, v in zip(out, (len(text), n, digest, None if a is None else unescape(text[a:b])), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=schema.names)

    parts = formatted.select("conv_id", "example", "is_last", "text", "loss_start", "loss_end").mapInArrow(take_apart, schema)
    loss = F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))
    found = parts.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_sort(F.collect_list(loss)).alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    masked = F.array_join(F.transform("loss", lambda x: x["loss"]), "")
    return found.select("conv_id", "n_turns", "turns_sha256", F.char_length(masked).cast("long").alias("loss_chars"),
                        F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars", "n_examples")
