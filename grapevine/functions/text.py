"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import TOPICS

# An answer may come wrapped in a Markdown code fence.
FENCE = r"^```(?:json)?\s*|\s*```$"


def strip_text(text: Column) -> Column:
    """Remove leading and trailing whitespace of any script (``trim`` only knows U+0020)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_body_text(title: Column, body: Column) -> Column:
    """Title and body as one text; a missing part still leaves the separator before the outer strip."""
    def part(column: Column) -> Column:
        return strip_text(F.coalesce(column, F.lit("")))

    return strip_text(F.concat(part(title), F.lit("\n\n"), part(body)))


def truncate_text(text: Column, length: int) -> Column:
    """The first ``length`` code points."""
    return F.substring(text, 1, length)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def without_prefix(text: Column, prefix: str) -> Column:
    """Drop ``prefix`` once, at the front."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def canonical_topic(topic: Column) -> Column:
    """Topics outside the vocabulary, and missing ones, become ``other``."""
    return F.when(topic.isin(TOPICS), topic).otherwise(F.lit("other"))


def fill_template(template: Column, values: dict[str, Column | str]) -> Column:
    """Replace ``{name}`` for every name in ``values``."""
    for name, value in values.items():
        value = F.lit(value) if isinstance(value, str) else value
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def json_text(value: Column) -> Column:
    """JSON of a struct or an array of structs; null fields are written, not dropped."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(strip_text(text), FENCE, "")


def parse_model_json(text: Column, schema: str) -> Column:
    """The answer as a struct. Malformed text leaves every field null, so test a field, not the struct."""
    return F.from_json(strip_fences(text), schema)


def first_text_block(blocks: Column) -> Column:
    """Text of the first block of type ``text``; answers may start with other block types."""
    return F.get(F.filter(blocks, lambda block: block["type"] == "text"), F.lit(0))["text"]


def cache_key(*parts: Column) -> Column:
    """``prompt|model|id`` and its longer forms."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit("|"))
        pieces.append(F.coalesce(part.cast("string"), F.lit("")))
    return F.concat(*pieces)


def reply_digest(reply: Column) -> Column:
    return F.substring(F.md5(reply), 1, 10)


def one_line(text: Column, length: int) -> Column:
    """A preview: cut first, then newlines become spaces."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def normalise_yes_no(answer: Column) -> Column:
    """``Y`` or ``N`` from free typing; anything else is null."""
    letter = F.substring(F.upper(strip_text(answer)), 1, 1)
    return F.when(letter.isin("Y", "N"), letter)
