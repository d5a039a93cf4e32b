"""HTML to plain text with Markdown tables, as a vectorised function.

A document is cut into tags and text by one expression and rendered in a single pass. Script and
style bodies are dropped unless ``parity`` asks for them. Null gives null, broken mark-up gives the text there is.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that end a line.
BREAKS = frozenset({"p", "div", "section", "article", "header", "footer", "ul", "ol", "li", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6"})
_PIECE = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<![^>]*>|([^<]+|<)", re.S)
_SKIPPED = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_SPAN = re.compile(r"colspan\s*=\s*[\"']?\s*(\d+)", re.I)


def _flat(text: str) -> str:
    return " ".join(text.split())


def markdown_table(rows: list[list[tuple[str, bool]]]) -> list[str]:
    """Lines of a table given as rows of (text, is header cell); short rows are padded."""
    rows = [r for r in rows if r]
    if not rows:
        return []
    width = max(map(len, rows))
    texts = [[c.replace("|", "\\|") for c, _ in r] + [""] * (width - len(r)) for r in rows]
    if not any(h for _, h in rows[0]):
        texts.insert(0, [f"col_{i}" for i in range(1, width + 1)])
    texts.insert(1, ["---"] * width)
    return [_flat("| " + " | ".join(t) + " |") for t in texts]


def render(html: str, parity: bool = False) -> str:
    """The text of a document: one line per block, ``* `` before list items, tables as Markdown."""
    lines, table, cell = [""], None, None

    def end_line() -> None:
        if lines[-1]:
            lines.append("")

    def end_cell() -> None:
        nonlocal cell
        if cell is not None and table:
            table[-1].append((_flat(" ".join(cell[0])), cell[1]))
            table[-1] += [("", cell[1])] * (cell[2] - 1)
        cell = None

    for m in _PIECE.finditer(html if parity else _SKIPPED.sub(" ", html)):
        close, tag, rest, text = m.groups()
        if text is not None:
            text = unescape(unescape(text) if parity else text)
            if text.strip():
                if cell is not None:
                    cell[0].append(text)
                else:
                    head, *more = text.split("\n")
                    lines[-1] += head
                    lines += more
            continue
        tag = (tag or "").lower()
        if tag == "table":
            if close and table is not None:
                end_cell()
                lines += [*markdown_table(table), ""]
                table = None
            elif not close:
                end_line()
                table = []
        elif table is not None and tag in ("tr", "td", "th"):
            end_cell()
            if tag == "tr" and not close:
                table.append([])
            elif tag != "tr" and not close:
                if not table:
                    table.append([])
                span = _SPAN.search(rest or "")
                cell = ([], tag == "th", max(1, min(1000, int(span.group(1)))) if span else 1)
        elif tag in BREAKS and cell is None:
            end_line()
            if tag == "li" and not close:
                lines[-1] = "* "
    if table is not None:
        end_cell()
        lines += markdown_table(table)
    return "\n".join(x for x in map(_flat, lines) if x)


def html_to_text(html: Column, parity: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else render(x, parity))

    return run(html)
