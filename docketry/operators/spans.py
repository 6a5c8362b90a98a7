"""Located passages of documents: paragraphs with offsets, page numbers and heading trails.

A text is cut at blank lines and page breaks inside its own row, in Arrow batches: the
trail of headings and the page number are carried along the blocks of one text, so
documents never meet and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.texts import HEADINGS, LONGEST_HEADING
from docketry.runtime import fresh, give_back

LEAST_SPAN = 40
SEPARATOR = re.compile(r"\f|\n[ \t]*\n+")
#: What counts as white space at the ends of a passage and in headings, and what ends a line.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_ENDS = "\n\r\u2028\u2029"


def exact(form: str) -> str:
    """A heading's form with its classes spelt out, so that engines whose classes differ read it alike."""
    form = form.replace(r"[A-Z\s", f"[A-Z{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(r"\d", "[0-9]")
    return form.replace(".{0,", f"[^{LINE_ENDS}]{{0,")


FORMS = [(level, re.compile(exact(form) + r"\Z")) for level, form in HEADINGS]
SPAN_DDL = "ordinal int, page int, char_start int, char_end int, text string, heading_path array<string>"
SPAN = pa.struct([*[(c, pa.int32()) for c in ("ordinal", "page", "char_start", "char_end")], ("text", pa.string()), ("heading_path", pa.list_(pa.string()))])
#: Documents whose passages are made at once.
ROWS = 64


def level_of(line: str) -> int | None:
    if len(line) <= LONGEST_HEADING:
        for level, form in FORMS:
            if form.match(line):
                return level
    return None


def spans_of(text: str) -> list[dict]:
    spans: list[dict] = []
    trail: list[str | None] = []
    page, at = (1 if "\f" in text else None), 0
    cuts = [(m.start(), m.end(), m[0] == "\f") for m in SEPARATOR.finditer(text)]
    for end, then, breaks in [*cuts, (len(text), len(text), False)]:
        block = text[at:end]
        body = block.strip(WHITE)
        level = level_of(body) if body else None
        if level is not None:
            # level 2 keeps the first entry, or leaves a hole where there is none
            trail = [body] if level == 1 else [*(trail[:1] or [None]), body]
        elif len(body) >= LEAST_SPAN:
            start = at + len(block) - len(block.lstrip(WHITE))
            spans.append(
                {"ordinal": len(spans) + 1, "page": page, "char_start": start, "char_end": start + len(body), "text": body, "heading_path": list(trail)}
            )
        page = page + 1 if breaks and page else page
        at = then
    return spans


def spanify(docs: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """One row per passage of LEAST_SPAN characters or more: the keys, ordinal, page, char_start,
    char_end, text and heading_path.

    Headings go into the trail of what follows instead of being passages. A heading of the
    second level before any of the first leaves a null in its place. page is null for a
    text without page breaks. Offsets count code points of the text as given. A null or
    empty text has no passages.
    """

    text = fresh(list(keys), "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [spans_of(t.as_py() or "") for t in part.column(len(keys))]
                row = pa.array([i for i, spans in enumerate(found) for _ in spans], pa.int64())
                made = pa.array([s for spans in found for s in spans], type=SPAN)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(row) for k in range(len(keys))], *made.flatten()], [*keys, *SPAN.names])
            give_back()

    kept = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
    return docs.select(*keys, F.col(text_col).alias(text)).mapInArrow(cut, ", ".join([*kept, SPAN_DDL]))


def page_count(text: Column) -> Column:
    """Pages of a text with page breaks, null without."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit("")))
    return F.when(breaks > 0, breaks + 1)


def chunks(spans: DataFrame, size: int = 25) -> DataFrame:
    """spans with ``chunk``, from 0: each holds the next size passages of its document."""
    return spans.withColumn("chunk", F.floor((F.col("ordinal") - 1) / size).cast("int"))
