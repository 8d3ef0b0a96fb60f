"""Chat texts from logs of events.

Events (conv_id, seq, op, msg, role, text) are dealt by conversation, sorted by seq, and folded:

* ``open``: message ``msg`` begins (again), with a role and the text so far;
* ``delta``: text is appended to message ``msg``;
* ``edit``: text replaces that of message ``msg``;
* ``regenerate``: message ``msg`` loses its text, and messages after it go.

Final messages, by msg, are rendered: ``### role: text</turn>`` and a line feed each.  Inside roles and texts a backslash goes before each
backslash, ``###`` and ``</turn>`` (and colon, in roles), which :func:`read_back` undoes.  The loss mask covers the escaped texts of assistants.

A task streams over its conversations and holds one at a time: the unit is what becomes one string.  Null ops, roles and texts
are empty; unknown ops and events on messages that were never opened open them with an empty role; equal seqs go by op, msg, role, text in that
order, and equal events apply each; a null conv_id is a conversation of its own.  Empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
BODY = re.compile(r"(?:[^\\<]++|\\(?:\\|###|</turn>|:)|<(?!/turn>))*+")
ROLE = re.compile(r"(?:[^\\:]++|\\(?:\\|###|</turn>|:))*+")


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def fold(events) -> list[tuple[str, str]]:
    """(role, text) of the final messages, from (op, msg, role, text) in order."""
    messages: dict[int, list] = {}
    for op, msg, role, text in events:
        if op == "open":
            messages[msg] = [role, [text]]
            continue
        entry = messages.setdefault(msg, ["", []])
        if op == "delta":
            entry[1].append(text)
        elif op == "edit":
            entry[1] = [text]
        elif op == "regenerate":
            entry[1] = []
            for later in [m for m in messages if m > msg]:
                del messages[later]
    return [(role, "".join(parts)) for _, (role, parts) in sorted(messages.items())]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text and the loss mask (ranges of code points)."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"### {escape(role, ROLE_CONTROL)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), mask


def read_back(text: str) -> list[tuple[str, str]]:
    """The messages of a rendered text."""
    at, out = 0, []
    while at < len(text):
        if not text.startswith("### ", at):
            raise ValueError(f"no turn at {at}")
        role = ROLE.match(text, at + 4)
        body = BODY.match(text, role.end() + 2)
        if not text.startswith("</turn>\n", body.end()):
            raise ValueError(f"the turn at {at} does not end")
        out.append((unescape(role[0]), unescape(body[0])))
        at = body.end() + 8
    return out


FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("mask", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of each conversation."""
    schema = T.StructType([events.schema["conv_id"], *FORMATTED])
    mask_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        def out(done):
            ids, texts, masks = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array([[{"start": a, "stop": z} for a, z in m] for m in masks], mask_type)], names=schema.names)

        none = object()
        current, held, done, kind, size = none, [], [], None, 0
        for b in batches:
            kind = b.column("conv_id").type
            cols = [b.column(c).to_pylist() for c in ("conv_id", "op", "msg", "role", "text")]
            for conv, op, msg, role, text in zip(*cols, strict=True):
                if conv != current or current is none:
                    if current is not none:
                        done.append((current, *render(fold(held))))
                        size += len(done[-1][1])
                        if len(done) >= 500 or size > 1 << 24:
                            yield out(done)
                            done, size = [], 0
                    current, held = conv, []
                held.append((op, msg, role, text))
        if current is not none:
            done.append((current, *render(fold(held))))
        if done:
            yield out(done)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = events.select("conv_id", "seq", blank("op"), F.coalesce(F.col("msg").cast("long"), F.lit(0)).alias("msg"), blank("role"), blank("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "op", "msg", "role", "text").drop("seq").mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame) -> DataFrame:
    """What the rendered texts and masks say when read back."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, mask in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                messages = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                turns = "".join(f"{r}\n{t}\n" for r, t in messages)
                rows.append((conv, len(messages), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rendered.mapInArrow(run, DIGEST)
