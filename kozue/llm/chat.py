"""Chat formatting by event-sourced reconstruction.

A log has one row an event. Logs are partitioned by conversation and sorted by sequence number; a fold over each turns events into
final messages, and these are rendered as one training text. A partition holds one conversation's messages at a time.

Kinds of events: "message" (also null) adds a message; "delta" appends its text to the last message if that has the event's role,
else adds one; "edit" replaces the text of the message that event `target` made, or of the last message if target is null;
"regenerate" drops the message that event `target` made (the last one of its role if null) and all after it, and adds a message
with the event's text, which deltas may go on. A target that made no message, or whose message is gone, changes nothing, but a
regenerate still adds its message. Other kinds are ignored.

Cases: rows without a conversation belong to none and are left out; a null sequence number comes first; events of one number
are applied in order of kind, role, text and target, and rows that are alike in all these are one event; a null role is
"unknown", a null text empty; "<|" within a text or role becomes "< |", so no text can end its message; a conversation
whose events leave no message has none and an empty text; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

BEGIN, END = "<|im_start|>", "<|im_end|>"


def fold(messages: list[list], event: tuple) -> None:
    """Apply an event (seq, kind, role, text, target) to messages, lists of the number that made them, role and parts of text."""
    seq, kind, role, text, target = event
    if kind == "message" or kind == "delta" and not (messages and messages[-1][1] == role):
        messages.append([seq, role, [text]])
    elif kind == "delta":
        messages[-1][2].append(text)
    elif kind == "edit":
        at = len(messages) - 1 if target is None else next((k for k in range(len(messages) - 1, -1, -1) if messages[k][0] == target), -1)
        if at >= 0:
            messages[at][2] = [text]
    elif kind == "regenerate":
        at = next((k for k in range(len(messages) - 1, -1, -1) if (messages[k][1] == role if target is None else messages[k][0] == target)), -1)
        if at >= 0:
            del messages[at:]
        messages.append([seq, role, [text]])


def render(messages: list[list]) -> str:
    out = []
    for _, role, parts in messages:
        out += [BEGIN, role.replace("<|", "< |"), "\n", "".join(parts).replace("<|", "< |"), END, "\n"]
    return "".join(out)


def format_chats(df: DataFrame, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", kind_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, n_messages, rendered."""
    kind = F.coalesce(col(kind_col), F.lit("message")) if kind_col else F.lit("message")
    target = col(target_col).cast("bigint") if target_col else F.lit(None).cast("bigint")
    events = df.filter(col(conv_col).isNotNull()).select(
        col(conv_col).alias("conv"),
        col(seq_col).cast("bigint").alias("seq"),
        kind.alias("kind"),
        F.coalesce(col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text"),
        target.alias("target"),
    )
    ordered = events.repartition("conv").sortWithinPartitions("conv", "seq", "kind", "role", "text", "target")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, messages, last = None, [], None
        out: list[tuple] = []
        weight = 0
        schema = None
        for batch in batches:
            schema = batch.schema.field(0).type
            for conv, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if now is not None:
                        out.append((now, len(messages), render(messages)))
                        weight += len(out[-1][2])
                    now, messages, last = conv, [], None
                if event != last:
                    fold(messages, tuple(event))
                    last = event
                if weight > 8 << 20:
                    yield _rows(out, schema)
                    out, weight = [], 0
        if now is not None:
            out.append((now, len(messages), render(messages)))
        if out:
            yield _rows(out, schema)

    kind_of = events.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(stage, f"conv_id {kind_of}, n_messages bigint, rendered string")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, n, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(n, pa.int64()), pa.array(text, pa.string())], ["conv_id", "n_messages", "rendered"])
