"""Visible text of HTML pages, as lines.

A page is reduced by one substitution for each kind of markup: comments and hidden elements go with all they hold (to
the page's end where they are never closed), tags of blocks become line breaks, all other tags vanish, and character
references are resolved last, once. Then white space is folded within each line and blank lines are dropped. A tag that
the page's end cuts off is dropped too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without visible text, and elements around which lines break.
HIDDEN = ("script", "style", "noscript")
BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "tr")

_REST = r"(?:[\s/][^<>]*)?"
#: These two are also what the SQL form of page text is made of, so they do without back references.
UNSEEN = "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{t}{_REST}>.*?(?:</{t}{_REST}>|\z)" for t in HIDDEN)])
BREAK = rf"(?is)</?(?:{'|'.join(BLOCKS)}){_REST}>"
TAG = r"(?s)<[a-zA-Z/!?][^<>]*(?:>|\z)"

_UNSEEN, _BREAK, _TAG = (re.compile(p.replace(r"\z", r"\Z")) for p in (UNSEEN, BREAK, TAG))


def visible_text(html: str) -> str:
    """Lines of visible text."""
    shown = unescape(_TAG.sub("", _BREAK.sub("\n", _UNSEEN.sub("", html))))
    folded = (" ".join(line.split()) for line in shown.splitlines())
    return "\n".join(filter(None, folded))


def page_text(html: Column | str) -> Column:
    """A column of visible text; nulls stay null."""

    def column(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([None if x is None else visible_text(x) for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(column, "string")(html)
