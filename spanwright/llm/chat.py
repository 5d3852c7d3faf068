"""Chat formatting: event logs of conversations folded into messages, then rendered."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import group_runs

# Kinds of events.  ``open`` begins a message with a role and perhaps text,
# ``delta`` adds text, ``edit`` replaces the text, ``regenerate`` empties it for
# deltas to come; both of the last drop all later messages.
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
# Control strings of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
# A formatted conversation is stored in parts of so many turns.
PART_TURNS = 256
# Cuts of a conversation are carried along its turns in chunks of this many.
CHUNK_TURNS = 4096


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of a log
    ``conv_id, seq, turn, kind, role, text`` (``turn`` numbers the messages).

    An event counts unless an ``edit`` or ``regenerate`` of an earlier turn of
    the conversation has a larger ``seq``; text counts from the last of these
    on the turn itself.  The last of them per turn is a maximum, carried along
    the turns in chunks, so no conversation is held in one task.  The role is
    the last one given.  Null texts are empty, a null role is empty, null
    conversations are one conversation; events of equal ``seq`` go by kind,
    role and text.  A turn without an ``open`` event that counts is dropped.
    """
    e = events.select(F.struct("conv_id", "turn").alias("key"), "seq", "kind", "role",
                      F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin(EDIT, REGENERATE)
    turns = e.groupBy("key").agg(F.max(F.when(reset, F.col("seq"))).alias("own"))
    turns = turns.select("*", F.struct("key.conv_id", F.floor(F.col("key.turn") / CHUNK_TURNS).alias("n")).alias("chunk"))
    inside = Window.partitionBy("chunk").orderBy("key.turn").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("c.conv_id").orderBy("c.n").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (turns.groupBy("chunk").agg(F.max("own").alias("most")).withColumnRenamed("chunk", "c")
              .select("c", F.max("most").over(along).alias("carried")))
    cuts = (turns.select("*", F.max("own").over(inside).alias("near"))
            .join(chunks, F.col("chunk") == F.col("c"))
            .select(F.col("key").alias("k"), "own", F.greatest("near", "carried").alias("before")))
    live = e.join(cuts, F.col("key") == F.col("k")).where(
        F.col("before").isNull() | (F.col("seq") > F.col("before")))
    item = F.struct("seq", "kind", "role", F.when(F.col("own").isNull() | (F.col("seq") >= F.col("own")),
                                                  F.col("text")).otherwise(F.lit("")).alias("text"))
    folded = live.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items"))
    role = F.filter("items", lambda x: x["role"].isNotNull())
    return (folded.where(F.exists("items", lambda x: x["kind"] == OPEN))
            .select("key.conv_id", "key.turn",
                    F.coalesce(F.try_element_at(role, F.lit(-1))["role"], F.lit("")).alias("role"),
                    F.concat_ws("", F.transform("items", lambda x: x["text"])).alias("text")))


def escaped(text: Column) -> Column:
    """Every backslash doubled, then ``<|`` written ``<\\|``: no control string
    is left, and :func:`unescape` gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def segments(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_end``: each message in the
    template; the text of learned roles is between the two offsets (code
    points of the segment), which are null for others."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    learned = F.col("role") == LEARNED
    return messages.select("conv_id", "turn", head.alias("head"), escaped(F.col("text")).alias("body"),
                           learned.alias("learned")).select(
        "conv_id", "turn", F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
        F.when(F.col("learned"), F.length("head")).alias("loss_start"),
        F.when(F.col("learned"), F.length("head") + F.length("body")).alias("loss_end"))


def render(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss``: a conversation is its parts
    in order; ``loss`` holds starts and ends of learned text in ``formatted``."""
    parted = segments(messages).select(
        F.col("conv_id"), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        "turn", "segment", "loss_start", "loss_end")
    parted = parted.select(F.xxhash64("conv_id", "part").alias("h"), "*")
    ordered = parted.repartition("h").sortWithinPartitions("h", "conv_id", "part", "turn")
    kind = dict(messages.dtypes)["conv_id"]

    def join(batches):
        for table in group_runs(batches, ["h"]):
            ids, parts = table.column("conv_id").to_pylist(), table.column("part").to_pylist()
            texts = table.column("segment").to_pylist()
            spans = list(zip(table.column("loss_start").to_pylist(), table.column("loss_end").to_pylist()))
            rows, held, loss, size = [], [], [], 0
            for i, text in enumerate(texts):
                held.append(text)
                if spans[i][0] is not None:
                    loss += [size + spans[i][0], size + spans[i][1]]
                size += len(text)
                if i + 1 == len(texts) or (ids[i + 1], parts[i + 1]) != (ids[i], parts[i]):
                    rows.append((ids[i], parts[i], len(held), "".join(held), loss))
                    held, loss, size = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], table.schema.field("conv_id").type),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                names=["conv_id", "part", "n_turns", "formatted", "loss"])

    return ordered.mapInArrow(join, f"conv_id {kind}, part long, n_turns long, formatted string, loss array<long>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text; an error if it isn't one."""
    found = list(re.finditer(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.DOTALL))
    if sum(len(m[0]) for m in found) != len(formatted):
        raise ValueError("text outside of turns")
    return [(unescape(m[1]), unescape(m[2])) for m in found]


def digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted``: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Parts of a conversation pass in order through running hashes; only one
    part is held at a time."""
    kind = dict(rendered.dtypes)["conv_id"]
    parts = (rendered.select(F.xxhash64("conv_id").alias("h"), "conv_id", "part", "formatted", "loss")
             .repartition("h").sortWithinPartitions("h", "conv_id", "part"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            ids = batch.column("conv_id")
            done = []
            for i, (conv, text, loss) in enumerate(zip(
                    ids.to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist())):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, *state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(loss[::2], loss[1::2]):
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield _digest_rows(done, ids.type)
            kept_type = ids.type
        if state is not None:
            yield _digest_rows([(now, *state)], kept_type)

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2].hexdigest() for r in rows]), pa.array([r[3] for r in rows], pa.int64()),
         pa.array([r[4].hexdigest() for r in rows]), pa.array([r[5] for r in rows], pa.int64())],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_chats(events: DataFrame) -> DataFrame:
    """Fold, then render: ``conv_id, part, n_turns, formatted, loss``."""
    return render(fold(events))
