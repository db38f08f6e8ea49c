"""Benchmark decontamination by a prefix-filtered join with exact verification.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased. Every window of WINDOW consecutive words
of an item (the whole item where it is shorter) is a set of word shingles. Containment of a whole window needs all of
them, so its prefix is one: the rarest, by counts over all documents. Documents look up their shingles among these
prefixes only; each match fixes where the window must begin (positional bound) and end (length bound) inside the
document, and then all words are compared. Words inside any verified occurrence are hit.

The index of the items is broadcast in blocks of BLOCK_BYTES of item text. One block is the usual case; more blocks are
searched one after another, each writes what it hits (row, spans, items), and the hits are joined to the documents at
the end, so that neither broadcast nor memory grows with the benchmark and texts are written once.

Defined results: null and wordless texts have no words and hit nothing; null or wordless items match nothing; an item
with a null id counts and shows as an empty string; equal item ids count once; empty tables give no hits or no rows;
repeated documents keep their rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, number_filter, quoted, slices

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 16 << 20
#: Bytes that become word objects at a time.
PIECE = 1 << 21

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def word_ids(text: str | None, ids: dict[bytes, int]) -> np.ndarray:
    """The id of each word, 0 for words that no item has."""
    data = (text or "").encode().translate(_FOLD)
    out, at, get = [], 0, ids.get
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        words = data[at : end if end >= 0 else len(data)].split()
        out.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        at = end + 1 if end >= 0 else len(data)
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)


def codes(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of known words begin, and their 64-bit codes. Equal shingles have equal codes; verification settles the rest."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids != 0
    good = known[:n].copy()
    for i in range(1, width):
        good &= known[i : n + i]
    at = np.flatnonzero(good)
    code = np.full(len(at), width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            code = (code ^ ids[at + i].astype(np.uint64)) * _MIX[0]
            code ^= code >> np.uint64(29)
            code *= _MIX[1]
    return at, code


class Items:
    """The windows of one block of items. `weigh` sets the rarity of shingles; then `find` searches documents."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.windows, self.owners = list(owners), [sorted(v) for v in owners.values()]
        self.widths = sorted({min(SHINGLE, len(w)) for w in self.windows})
        parts = [codes(np.array(w, np.int32), min(SHINGLE, len(w)))[1] for w in self.windows]
        self.shingles = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.parts = parts

    def count(self, ids: np.ndarray, into: np.ndarray) -> None:
        for width in self.widths:
            _, code = codes(ids, width)
            where = np.searchsorted(self.shingles, code)
            where[where == len(self.shingles)] = 0
            found = where[self.shingles[where] == code] if len(self.shingles) else where[:0]
            into += np.bincount(found, minlength=len(into))

    def weigh(self, counts: np.ndarray) -> Items:
        """Choose each window's rarest shingle and order the windows by it."""
        entries = []
        for w, part in enumerate(self.parts):
            where = np.searchsorted(self.shingles, part)
            offset = int(np.lexsort((where, counts[where]))[0])
            entries.append((int(part[offset]), w, offset))
        entries.sort()
        self.keys, first = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True)
        self.first = np.append(first, len(entries)).astype(np.int64)
        self.entry_window, self.entry_offset = (np.array([e[i] for e in entries], np.int64) for i in (1, 2))
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.flat = np.array([x for w in self.windows for x in w], np.int32)
        del self.parts
        return self

    def find(self, ids: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence in the joined documents; doc_of tells the document of a word, -1 between two."""
        starts, windows = [], []
        for width in self.widths:
            at, code = codes(ids, width)
            key = np.searchsorted(self.keys, code)
            key[key == len(self.keys)] = 0
            hit = self.keys[key] == code
            at, key = at[hit], key[hit]
            many = self.first[key + 1] - self.first[key]
            entry = np.repeat(self.first[key] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            window = self.entry_window[entry]
            start = np.repeat(at, many) - self.entry_offset[entry]
            end = start + self.lengths[window]
            fits = (start >= 0) & (end <= len(ids))
            start, end, window = start[fits], end[fits], window[fits]
            fits = doc_of[start] == doc_of[end - 1]
            start, window = start[fits], window[fits]
            for length in np.unique(self.lengths[window]):
                own = self.lengths[window] == length
                s, w, span = start[own], window[own], np.arange(length)
                same = np.ones(len(s), bool)
                for i in span:  # narrows down: most false candidates differ early
                    live = np.flatnonzero(same)
                    same[live] = ids[s[live] + i] == self.flat[self.begin[w[live]] + i]
                starts.append(s[same])
                windows.append(w[same])
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joined(batch: pa.Array, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Word ids of all texts with a 0 after each, the text of each word (-1 for the zeros), and the numbers of words."""
    parts, sizes, zero = [], [], np.zeros(1, np.int32)
    for x in batch:
        own = word_ids(x.as_py(), ids)
        sizes.append(len(own))
        parts += [own, zero]
    doc_of = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64) + 1) if sizes else np.zeros(0, np.int64)
    if sizes:
        doc_of[np.cumsum(np.array(sizes, np.int64) + 1) - 1] = -1
    return np.concatenate(parts) if parts else zero[:0], doc_of, sizes


FOUND = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def found_in(batch: pa.Array, index: Items) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    ids, doc_of, sizes = joined(batch, index.ids)
    start, window = index.find(ids, doc_of)
    spans, items = defaultdict(set), defaultdict(set)
    base = np.cumsum(np.array(sizes, np.int64) + 1) - np.array(sizes, np.int64) - 1
    for d, s, w in zip(doc_of[start].tolist(), start.tolist(), window.tolist(), strict=True):
        spans[d].add((int(s - base[d]), int(s - base[d] + index.lengths[w])))
        items[d].update(index.owners[w])
    return [(n, merge(list(spans[d])) if d in spans else [], items.get(d, set())) for d, n in enumerate(sizes)]


def search_udf(index):
    """index: a broadcast of Items."""

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for piece in slices(texts):
                out = [{"n_words": n, "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)} for n, spans, items in found_in(piece, index.value)]
                yield pa.array(out, _ARROW)

    return F.arrow_udf(search, FOUND)


def merge_udf(spans: Column) -> Column:
    def merged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in columns:
            own = [merge([(x["a"], x["b"]) for x in row]) for row in batch.to_pylist()]
            yield pa.array([[{"a": a, "b": b} for a, b in row] for row in own], _ARROW.field("spans").type)

    return F.arrow_udf(merged, "array<struct<a:bigint,b:bigint>>")(spans)


def count_kernel(index):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        counts = np.zeros(len(own.shingles), np.int64)
        for batch in batches:
            for piece in slices(batch.column(0)):
                own.count(joined(piece, own.ids)[0], counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["shingle", "n"])

    return count


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about block_bytes of text, each small enough for the driver and a broadcast."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for b in range(n):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "found"
) -> DataFrame:
    """docs with a column `name`: n_words, spans of hit words (merged, from a up to b) and the ids of the items found."""
    spark, blocks = docs.sparkSession, blocks_of(benchmark, item_id_col, item_text_col, block_bytes)
    text = F.col(quoted(text_col))

    def search(df: DataFrame, rows: list[tuple[str, str | None]], into: str) -> DataFrame:
        index = Items(rows, window)
        counts = np.zeros(len(index.shingles), np.int64)
        if len(counts):
            seen = df.select(text).mapInArrow(count_kernel(spark.sparkContext.broadcast(index)), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
            for r in seen.collect():  # at most one row for each shingle of the block
                counts[r["shingle"]] = r["n"]
        return df.withColumn(into, search_udf(spark.sparkContext.broadcast(index.weigh(counts)))(text))

    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return search(docs, first, name)
    # more blocks: each gives the rows that it hits, and only their spans and items are written
    row, mark = fresh(docs, "row"), fresh(docs, "hits")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontam")
    hits = []
    for rows in chain([first, second], blocks):
        found = search(keyed.select(row, text), rows, mark).where(F.size(F.col(mark)["spans"]) > 0)
        hits.append(materialize(found.select(row, F.col(mark)["spans"].alias("spans"), F.col(mark)["items"].alias("items")), "hits"))
    together = reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    together = materialize(together.select(row, merge_udf(F.col("spans")).alias("spans"), "items"), "hits")
    counted = search(keyed, [], name)  # no items: the numbers of words
    maybe = number_filter(together.select(row))(F.col(row))
    joined_ = counted.where(maybe).join(together, row, "left")
    whole = F.when(F.col("spans").isNull(), F.col(name)).otherwise(F.struct(F.col(name)["n_words"].alias("n_words"), "spans", "items"))
    columns = list(map(quoted, docs.columns))
    return counted.where(~maybe).select(*columns, name).unionByName(joined_.select(*columns, whole.alias(name)))


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda total, s: total + s["b"] - s["a"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    f = F.col("found")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit(f).alias("n_hit"), F.size(f["items"]).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(f["items"])), 256).alias("items_sha256"), (n_hit(f) > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows in which no benchmark window occurs, with all their columns."""
    mark = fresh(docs, "found")
    return contamination(docs, benchmark, text_col=text_col, name=mark, **options).where(F.size(F.col(mark)["spans"]) == 0).select(*(F.col(quoted(c)) for c in docs.columns))
