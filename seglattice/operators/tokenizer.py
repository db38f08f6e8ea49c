"""Tokenization as DataFrame columns.

A `Tokenizer` compiles its dictionary once, broadcasts it, and gives Arrow columns of a text column. Every worker keeps
one kernel and its memory of pieces for all batches of a task. Nulls stay null. Columns that only count or locate take
a compiled dictionary without features.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SPANS, TOKENS, UNKNOWN_BASE, DictionaryError
from ..sources.dictionary import Dictionary
from .kernel import Kernel, compile_dictionary

_NEWLINE = re.compile("\r?\n")
#: Kernels of this Python worker, by broadcast; the last few only.
_KERNELS: dict[int, Kernel] = {}


def kernel_of(broadcast) -> Kernel:
    key = id(broadcast.value)  # a worker reads a broadcast once and keeps it
    if key not in _KERNELS or _KERNELS[key].d is not broadcast.value:
        if len(_KERNELS) > 3:
            _KERNELS.clear()
        _KERNELS[key] = Kernel(broadcast.value)
        gc.set_threshold(50_000, 50, 100)  # remembered pieces are many and hold no cycles
    return _KERNELS[key]


def byte_offsets(text: str) -> np.ndarray | None:
    """Bytes before each character and the end; None where they equal the characters before."""
    if text.isascii():
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    return np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))


def _offsets(texts: list[str | None], sizes: list[int]) -> pa.Array:
    """List offsets; a null text is a null list."""
    ends = np.append(0, np.cumsum(sizes)).tolist()
    return pa.array([None if i < len(texts) and texts[i] is None else e for i, e in enumerate(ends)], pa.int32())


def token_lists(texts: list[str | None], kernel: Kernel) -> pa.ListArray:
    surfaces, words, costs, a_chars, b_chars, a_bytes, b_bytes, sizes = [], [], [], [], [], [], [], []
    for text in texts:
        found = kernel.tokenize(text or "")
        sizes.append(len(found))
        if not found:
            continue
        a, b, w, c = zip(*found, strict=True)
        surfaces += [text[i:j] for i, j in zip(a, b, strict=True)]
        words += w
        costs += c
        a_chars += a
        b_chars += b
        place = byte_offsets(text)
        a_bytes += a if place is None else place[list(a)].tolist()
        b_bytes += b if place is None else place[list(b)].tolist()
    ids = np.array(words, np.int64)
    known, back = np.unique(ids, return_inverse=True)
    features = pa.array([kernel.feature(w) for w in known.tolist()], pa.string()).take(pa.array(back)) if len(ids) else pa.array([], pa.string())
    int32 = pa.int32()
    columns = [pa.array(surfaces, pa.string()), pa.array(a_bytes, int32), pa.array(b_bytes, int32), pa.array(a_chars, int32), pa.array(b_chars, int32), pa.array(ids), features, pa.array(costs, pa.int64()), pa.array(ids >= UNKNOWN_BASE)]
    return pa.ListArray.from_arrays(_offsets(texts, sizes), pa.StructArray.from_arrays(columns, ["surface", "start", "end", "start_char", "end_char", "word_id", "feature", "total_cost", "is_unknown"]))


def span_lists(texts: list[str | None], kernel: Kernel) -> pa.ListArray:
    a_bytes, b_bytes, words, sizes = [], [], [], []
    for text in texts:
        found = kernel.tokenize(text or "")
        sizes.append(len(found))
        if found:
            a, b, w, _ = zip(*found, strict=True)
            place = byte_offsets(text)
            a_bytes += a if place is None else place[list(a)].tolist()
            b_bytes += b if place is None else place[list(b)].tolist()
            words += w
    columns = [pa.array(a_bytes, pa.int32()), pa.array(b_bytes, pa.int32()), pa.array(words, pa.int64())]
    return pa.ListArray.from_arrays(_offsets(texts, sizes), pa.StructArray.from_arrays(columns, ["start", "end", "word_id"]))


def counts(texts: list[str | None], kernel: Kernel) -> pa.Array:
    return pa.array([None if t is None else kernel.count(t) for t in texts], pa.int32())


def line_counts(texts: list[str | None], kernel: Kernel) -> pa.Array:
    """Lines, without an empty one at the end, and the words of all of them."""
    out = []
    for t in texts:
        own = [] if t is None else _NEWLINE.split(t)
        if own and not own[-1]:
            own.pop()
        out.append(None if t is None else {"lines": len(own), "words": sum(map(kernel.count, own))})
    return pa.array(out, pa.struct([("lines", pa.int32()), ("words", pa.int64())]))


def costs(texts: list[str | None], kernel: Kernel) -> pa.Array:
    """The total cost of each text's path, 0 without words."""
    return pa.array([None if t is None else (found[-1][3] if (found := kernel.tokenize(t)) else 0) for t in texts], pa.int64())


def surfaces(texts: list[str | None], kernel: Kernel) -> pa.Array:
    return pa.array([None if t is None else " ".join([t[a:b] for a, b, _, _ in kernel.tokenize(t)]) for t in texts], pa.string())


def reachable(texts: list[str | None], kernel: Kernel) -> pa.Array:
    return pa.array([None if t is None else kernel.reachable(t) for t in texts], pa.list_(pa.int32()))


def kernel_udf(broadcast, make: Callable[[list[str | None], Kernel], pa.Array], kind: str):
    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = kernel_of(broadcast)
        for batch in texts:
            for at in range(0, max(1, len(batch)), 512):  # rows at a time: bounds the token lists in memory
                yield make(batch.slice(at, 512).to_pylist(), kernel)

    return F.arrow_udf(column, kind)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file would keep one core busy. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tokenizer:
    """Columns of words for a dictionary and options. max_grouping 0: no limit on grouped unknown words."""

    def __init__(self, spark: SparkSession, dictionary: Dictionary, *, ignore_space: bool = False, max_grouping: int = 0):
        self.dictionary, self.ignore_space, self.max_grouping, self.context = dictionary, ignore_space, max_grouping, spark.sparkContext
        if ignore_space and dictionary.category_id("SPACE") is None:
            raise DictionaryError("ignoring spaces takes a category SPACE")

    @cached_property
    def full(self):
        """The compiled dictionary with features, broadcast when a column first needs them."""
        return self.context.broadcast(compile_dictionary(self.dictionary, self.ignore_space, self.max_grouping))

    @cached_property
    def bare(self):
        """The compiled dictionary of columns that only count or locate; a tokenizer that only counts never ships features."""
        return self.context.broadcast(compile_dictionary(self.dictionary, self.ignore_space, self.max_grouping, features=False))

    def tokenize_udf(self):
        return kernel_udf(self.full, token_lists, TOKENS)

    def spans_udf(self):
        return kernel_udf(self.bare, span_lists, SPANS)

    def count_udf(self):
        return kernel_udf(self.bare, counts, "int")

    def cost_udf(self):
        return kernel_udf(self.bare, costs, "bigint")

    def wakati_udf(self):
        return kernel_udf(self.bare, surfaces, "string")

    def tokenize(self, text: Column | str) -> Column:
        """array<struct<surface, start, end, start_char, end_char, word_id, feature, total_cost, is_unknown>>"""
        return self.tokenize_udf()(text)

    def tokenize_spans(self, text: Column | str) -> Column:
        """array<struct<start, end, word_id>>, in bytes"""
        return self.spans_udf()(text)

    def tokenize_count(self, text: Column | str) -> Column:
        return self.count_udf()(text)

    def line_counts(self, text: Column | str) -> Column:
        """struct<lines, words>: each line is a text of its own."""
        return kernel_udf(self.bare, line_counts, "struct<lines:int,words:bigint>")(text)

    def path_cost(self, text: Column | str) -> Column:
        return self.cost_udf()(text)

    def wakati(self, text: Column | str) -> Column:
        """Words joined by single spaces."""
        return self.wakati_udf()(text)

    def reachable(self, text: Column | str) -> Column:
        """array<int>: the character positions that a chain of edges from the start meets."""
        return kernel_udf(self.bare, reachable, "array<int>")(text)

    def mecab(self, text: Column | str) -> Column:
        return mecab_text(self.tokenize(text))

    def json(self, text: Column | str) -> Column:
        return json_text(self.tokenize(text))


# -- output formats of a token column


def wakati_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["surface"]), " ")


def mecab_text(tokens: Column) -> Column:
    """One line "surface TAB feature" for each word, then EOS."""
    return F.concat(F.array_join(F.transform(tokens, lambda t: F.concat(t["surface"], F.lit("\t"), t["feature"], F.lit("\n"))), ""), F.lit("EOS"))


def json_text(tokens: Column) -> Column:
    names = {"surface": "surface", "feature": "feature", "start": "start", "end": "end", "startChar": "start_char", "endChar": "end_char", "wordId": "word_id", "totalCost": "total_cost", "unknown": "is_unknown"}
    return F.to_json(F.transform(tokens, lambda t: F.struct(*(t[own].alias(name) for name, own in names.items()))))


def part_of_speech(feature: Column) -> Column:
    """The first four comma-separated parts that are neither empty nor an asterisk, joined by hyphens; the feature if there are none."""
    named = F.array_join(F.filter(F.slice(F.split(feature, ","), 1, 4), lambda p: (p != "*") & (p != "")), "-")
    return F.when(named == "", feature).otherwise(named)


def reading(feature: Column) -> Column:
    """The eighth part, empty where there is none or an asterisk."""
    part = F.coalesce(F.get(F.split(feature, ","), F.lit(7)), F.lit(""))
    return F.when(part == "*", "").otherwise(part)


#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 200_000


def word_frequencies(df: DataFrame, text: str, tokenizer: Tokenizer) -> DataFrame:
    """(surface, is_unknown, n, rows): how often each word occurs in a text column, and in how many rows.

    Tasks count their rows' words first and pass on one row for each word, so what is shuffled follows the number of
    distinct words, not of words.
    """
    shared = tokenizer.bare

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total, rows = kernel_of(shared), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(total)
            columns = [pa.array([s for s, _ in names], pa.string()), pa.array([u for _, u in names], pa.bool_()), pa.array([total[k] for k in names], pa.int64()), pa.array([rows[k] for k in names], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["surface", "is_unknown", "n", "rows"])

        for batch in batches:
            for t in batch.column(0):
                own = t.as_py() or ""
                found = Counter((own[a:b], w >= UNKNOWN_BASE) for a, b, w, _ in kernel.tokenize(own))
                total.update(found)
                rows.update(found.keys())
                if len(total) > COUNTED_WORDS:
                    yield counted()
                    total.clear()
                    rows.clear()
        yield counted()

    parts = df.select(text).mapInArrow(count, "surface string, is_unknown boolean, n bigint, rows bigint")
    return parts.groupBy("surface", "is_unknown").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def explode_tokens(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """A row for each word: its number from 0 and its fields."""
    return df.select(*keep, F.posexplode(tokens).alias("position", "t")).select(*keep, "position", "t.*")
