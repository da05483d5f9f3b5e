"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to one string. Nothing is assumed about it: successive prefixes of a
conversation are rendered and consecutive outputs compared. What the next output adds is the turn's span; two renderings with
different one-character texts show where the text sits in it. If the older output does not survive the next turn, but
for one insertion, the template rewrites history: ``rewrites`` is set and there are no spans.

Turns are in order of turn, role and text; repeated rows are turns of their own. Null texts and roles are empty, and rows
with a null conversation id form one conversation. A conversation becomes one text, so its turns meet in one task; two
renderings are held at a time. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType,
)

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat formats, first character and rest.
CONTROLS = [("<", "|"), ("<", "/s>"), ("<", "s>"), ("[", "INST]"), ("[", "/INST]"), ("<", "<SYS>>"), ("<", "</SYS>>")]


def control_pattern(backslash: str) -> re.Pattern:
    """A control string's first character, then ``backslash``, before its backslashes and its rest."""
    rests: dict[str, list[str]] = {}
    for first, rest in CONTROLS:
        rests.setdefault(first, []).append(re.escape(rest))
    return re.compile("|".join(rf"{re.escape(first)}{backslash}(?=\\*(?:{'|'.join(own)}))" for first, own in rests.items()))


ESCAPE, UNESCAPE = control_pattern(""), control_pattern(r"\\")
FIRSTS = sorted({first for first, _ in CONTROLS})


def escape(text: str) -> str:
    """One backslash more after the first character of each control string, escaped or not: none is left, all can be undone."""
    return ESCAPE.sub(lambda found: found[0] + "\\", text) if any(first in text for first in FIRSTS) else text


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda found: found[0][0], text) if "\\" in text else text


def marked(turns: list[Turn]) -> str:
    """The own template: start mark, role, line feed, escaped text, end mark, line feed."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_marked(output: str) -> list[Turn]:
    """The turns of an output of ``marked``."""
    turns = []
    for part in output.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: -len(END) - 1])))
    return turns


def common_prefix(a: str, b: str) -> int:
    """Length of the common start, by halving: strings are compared whole, not by character."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])


def located(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """(output, for each turn where its span and its text start and end), or None in place of spans if history is rewritten."""
    output, spans = template([]) if turns else "", []
    for k in range(len(turns)):
        before, role = turns[:k], turns[k][0]
        longer = template([*before, turns[k]])
        # the same turn with two other texts: what they share is the turn's frame
        one, two = template([*before, (role, "a")]), template([*before, (role, "b")])
        head, tail = common_prefix(one, two), common_suffix(one, two)
        start = common_prefix(output, one)
        kept = len(output) - start  # what the older output had after the new turn
        if not (output[start:] == longer[len(longer) - kept:] and output[:start] == longer[:start]) or head + tail > len(longer):
            return template(turns), None
        spans.append((start, len(longer) - kept, head, len(longer) - tail))
        output = longer
    return output, spans


def format_conversations(
    rows: DataFrame, template: Template = marked, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learned_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``rewrites`` and ``spans`` (start, end, text_start, text_end, role, loss).

    Offsets are code points of ``formatted``; ``loss`` marks the texts of ``learned_roles``.
    """
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conversation).alias("_conversation")).agg(F.array_sort(F.collect_list(own)).alias("turns"))
    whole = whole.select("_conversation", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, rewrites, spans = [], [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                output, found = located(list(zip(roles, texts, strict=True)), template)
                outputs.append(output)
                rewrites.append(found is None)
                spans.append([
                    {"start": a, "end": b, "text_start": c, "text_end": d, "role": own, "loss": own in learned_roles}
                    for own, (a, b, c, d) in zip(roles, found or [], strict=found is not None)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(outputs, pa.string()), pa.array(rewrites, pa.bool_()), pa.array(spans, SPANS)],
                names=[conversation, "formatted", "rewrites", "spans"],
            )

    schema = StructType([
        StructField(conversation, rows.schema[conversation].dataType), StructField("formatted", StringType()),
        StructField("rewrites", BooleanType()),
        StructField("spans", ArrayType(StructType([
            *(StructField(name, LongType()) for name in ("start", "end", "text_start", "text_end")),
            StructField("role", StringType()), StructField("loss", BooleanType()),
        ]))),
    ])
    return whole.mapInArrow(rendered, schema)


SPANS = pa.list_(pa.struct([
    *((name, pa.int64()) for name in ("start", "end", "text_start", "text_end")), ("role", pa.string()), ("loss", pa.bool_()),
]))


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, turns, loss): the turns parsed from the output, and all text under the loss mask, unescaped."""
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for output, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append([{"role": role, "text": text} for role, text in read_marked(output)])
                losses.append("".join(unescape(output[s["text_start"]:s["text_end"]]) for s in spans if s["loss"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(turns, TURNS), pa.array(losses, pa.string()), batch.column(1)],
                names=[conversation, "turns", "loss", "formatted"],
            )

    schema = StructType([
        formatted.schema[conversation],
        StructField("turns", ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))),
        StructField("loss", StringType()), StructField("formatted", StringType()),
    ])
    return formatted.select(conversation, "formatted", "spans").mapInArrow(parsed, schema)


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
