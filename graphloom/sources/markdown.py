"""Markdown texts as rows: blocks that tile a text, and the inline tokens that tile a block's text.

A text is cut by the kinds of its lines, so a task needs one text at a time; tables, lists and fences are runs of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.runtime import prepare_python
from graphloom.schema import fields

# The syntax of lines and of inline marks, as patterns.
RULE = re.compile(r"(---|___|\*\*\*)$")
HEADING = re.compile(r"(#{1,4})\s+(.+)$")
TASK = re.compile(r"-\s+\[([ xX])\]\s+(.+)$")
BULLET = re.compile(r"[-*+]\s+(.+)$")
NUMBERED = re.compile(r"\d+\.\s+(.+)$")
DIVIDER = re.compile(r"[|\s\-:]+$")
INLINE = re.compile(r"(?P<code>`[^`]+`)|(?P<bold>\*\*[^*]+\*\*|__[^_]+__)|(?P<italic>\*[^*]+\*|_[^_]+_)|(?P<strikethrough>~~[^~]+~~)|(?P<link>\[[^\]]+\]\([^)]+\))|(?P<mention>@[a-zA-Z0-9_-]+)|(?P<tag>#[a-zA-Z0-9_-]+)")
SAFE = re.compile(r"(#|/|\./|\.\./|https?:|mailto:)", re.IGNORECASE)
MARKS = {"code": 1, "bold": 2, "italic": 1, "strikethrough": 2, "mention": 0, "tag": 0}

BLOCKS = "nth int, item int, kind string, level int, info string, checked boolean, text string, cells array<string>, begin int, until int"
INLINES = "array<struct<kind:string,raw:string,content:string,href:string>>"


def inlines(text: str) -> list[dict]:
    """Tokens whose ``raw`` parts, one after the other, are the text; links to other schemes than the safe ones lead nowhere."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        if m.start() > at:
            out.append({"kind": "text", "raw": text[at : m.start()], "content": text[at : m.start()], "href": None})
        kind, raw = m.lastgroup, m[0]
        if kind == "link":
            content, _, href = raw[1:-1].partition("](")
            href = href.strip()
            out.append({"kind": kind, "raw": raw, "content": content, "href": href if SAFE.match(href) else "#"})
        else:
            n = MARKS[kind]
            out.append({"kind": kind, "raw": raw, "content": raw[n : len(raw) - n], "href": None})
        at = m.end()
    if at < len(text):
        out.append({"kind": "text", "raw": text[at:], "content": text[at:], "href": None})
    return out


def _is_row(line: str) -> bool:
    return line.startswith("|") and line.endswith("|")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line[1:-1].split("|")]


def _class(lines: list[str], i: int) -> str:
    """What a line begins, outside fences."""
    line = lines[i]
    if not line:
        return "blank"
    if RULE.match(line):
        return "rule"
    if line.startswith("```"):
        return "code"
    if HEADING.match(line):
        return "heading"
    if line.startswith(">"):
        return "quote"
    for kind, pattern in (("task", TASK), ("bullet", BULLET), ("numbered", NUMBERED)):
        if pattern.match(line):
            return kind
    if _is_row(line) and i + 1 < len(lines) and "|" in lines[i + 1] and DIVIDER.match(lines[i + 1]):
        return "table"
    return "paragraph"


def blocks(text: str) -> list[tuple]:
    """Blocks in order, as in ``BLOCKS`` from item on; lists and tables have a row for each item. Each row's part of the text
    ends where the next one's begins, blank lines being blocks too."""
    ends, at = [], 0
    for line in text.split("\n"):
        at += len(line) + 1
        ends.append(min(at, len(text)))
    raw = text.split("\n")
    lines = [x.strip() for x in raw]
    out: list[tuple] = []
    i = nth = 0

    def add(kind, first, last, item=None, level=None, info=None, checked=None, text=None, cells=None):
        out.append((nth, item, kind, level, info, checked, text, cells, ends[first - 1] if first else 0, ends[last - 1]))

    while i < len(lines):
        kind, j = _class(lines, i), i + 1
        if kind == "rule" or kind == "blank":
            add(kind, i, j)
        elif kind == "heading":
            marks, content = HEADING.match(lines[i]).groups()
            add(kind, i, j, level=len(marks), text=content)
        elif kind == "code":
            while j < len(lines) and not lines[j].startswith("```"):
                j += 1
            add(kind, i, min(j + 1, len(lines)), info=lines[i][3:].strip() or "text", text="\n".join(raw[i + 1 : j]))
            j = min(j + 1, len(lines))
        elif kind == "table":
            add(kind, i, i + 2, item=0, cells=_cells(lines[i]))
            j = i + 2
            while j < len(lines) and _is_row(lines[j]):
                add(kind, j, j + 1, item=j - i - 1, cells=_cells(lines[j]))
                j += 1
        elif kind in ("task", "bullet", "numbered"):
            j = i
            while j < len(lines) and _class(lines, j) == kind:
                if kind == "task":
                    mark, content = TASK.match(lines[j]).groups()
                    add(kind, j, j + 1, item=j - i, checked=mark != " ", text=content)
                else:
                    add(kind, j, j + 1, item=j - i, text=(BULLET if kind == "bullet" else NUMBERED).match(lines[j])[1])
                j += 1
        elif kind == "quote":
            while j < len(lines) and lines[j].startswith(">"):
                j += 1
            add(kind, i, j, text="\n".join(re.sub(r"^>\s?", "", x) for x in lines[i:j]))
        else:
            # A line that only looks like a heading or a table's row stands alone; others join up to one that begins a block.
            if not lines[i].startswith("#") and not _is_row(lines[i]):
                while j < len(lines) and _class(lines, j) == "paragraph" and not lines[j].startswith("#") and not _is_row(lines[j]):
                    j += 1
            add(kind, i, j, text=" ".join(lines[i:j]))
        i, nth = j, nth + 1
    return out


def markdown_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """The blocks of each row's text, with the row's other columns and ``inlines``, the tokens of the block's text.

    Null texts have no blocks; an empty text is one blank. ``begin`` and ``until`` count characters, and the parts of a text
    follow each other without gap.
    """
    prepare_python(df.sparkSession)
    kept = [c for c in df.columns if c != text]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    own = d.schema["own"].dataType.simpleString()
    schema = f"own {own}, {BLOCKS}, inlines {INLINES}"

    kinds = to_arrow_schema(fields(f"{BLOCKS}, inlines {INLINES}"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, of = [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    found = blocks(t)
                    rows += [(*b, inlines(b[6]) if b[6] is not None and b[2] != "code" else []) for b in found]
                    of += [k] * len(found)
                columns = [pa.array([r[c] for r in rows], kinds.field(c).type) for c in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *columns], ["own", *names, "inlines"])

    return d.mapInArrow(cut, schema).select("own.*", *names, "inlines")
