"""SQL names for a tokenizer.

`register` adds tok_tokens, tok_spans, tok_count, tok_cost and tok_wakati as scalar functions, tok_json and tok_mecab as
text, and the table function tok_rows(text), for LATERAL joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import Kernel
from ..operators.tokenizer import Tokenizer, byte_offsets, kernel_of, kernel_udf
from ..schema import UNKNOWN_BASE
from ..sources.dictionary import Dictionary

ROWS = "position int, surface string, start int, end int, start_char int, end_char int, word_id bigint, feature string, total_cost bigint, is_unknown boolean"


def fields(text: str, kernel: Kernel) -> Iterator[tuple]:
    """The fields of each word."""
    place = byte_offsets(text)
    for a, b, w, c in kernel.tokenize(text):
        yield text[a:b], a if place is None else int(place[a]), b if place is None else int(place[b]), a, b, w, kernel.feature(w), c, w >= UNKNOWN_BASE


def mecab_of(texts: list[str | None], kernel: Kernel) -> pa.Array:
    return pa.array([None if t is None else "".join(f"{t[a:b]}\t{kernel.feature(w)}\n" for a, b, w, _ in kernel.tokenize(t)) + "EOS" for t in texts], pa.string())


# How JSON strings escape characters, apart from other control characters.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPE = {**{i: f"\\u00{i:02x}" for i in range(32)}, **{ord(k): v for k, v in _ESCAPES.items()}}


def json_of(texts: list[str | None], kernel: Kernel) -> pa.Array:
    """Arrays of objects in the listed order of keys."""

    def one(t: str) -> str:
        objects = (f'{{"surface":"{s.translate(_ESCAPE)}","feature":"{f.translate(_ESCAPE)}","start":{a},"end":{b},"startChar":{i},"endChar":{j},"wordId":{w},"totalCost":{c},"unknown":{str(u).lower()}}}' for s, a, b, i, j, w, f, c, u in fields(t, kernel))
        return f"[{','.join(objects)}]"

    return pa.array([None if t is None else one(t) for t in texts], pa.string())


#: Grouped unknown words of the functions' own tokenizer are at most one character longer than this.
DEFAULT_GROUPING = 24


def register(spark: SparkSession, tokenizer: Tokenizer | None = None, prefix: str = "tok_") -> None:
    """Register all functions; without a tokenizer, for the built-in dictionary and grouping up to DEFAULT_GROUPING."""
    tokenizer = Tokenizer(spark, Dictionary.builtin(), max_grouping=DEFAULT_GROUPING) if tokenizer is None else tokenizer
    named = {
        "tokens": tokenizer.tokenize_udf(), "spans": tokenizer.spans_udf(), "count": tokenizer.count_udf(), "cost": tokenizer.cost_udf(), "wakati": tokenizer.wakati_udf(),
        "mecab": kernel_udf(tokenizer.full, mecab_of, "string"), "json": kernel_udf(tokenizer.full, json_of, "string"),
    }
    for name, function in named.items():
        spark.udf.register(f"{prefix}{name}", function)
    shared = tokenizer.full

    class Rows:
        def eval(self, text: str | None):
            for position, values in enumerate(fields(text or "", kernel_of(shared))):
                yield position, *values

    spark.udtf.register(f"{prefix}rows", F.udtf(Rows, returnType=ROWS))
