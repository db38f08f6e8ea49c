"""The lattice as DataFrames: characters, categories, runs, known and unknown edges, space links, connection costs.

What belongs to one text is computed where the text is: an Arrow column gives a text's characters with their byte
ranges, runs and matches as one array, from whole batches at a time, and a generator makes rows of it. So no character
is shuffled, repeated or null keys mix nothing, and a long text is no sort of its own. `key` is a column to keep.
Positions count characters from 0; ends are exclusive; null texts have no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FALLBACK_COST, OUTSIDE_COST, UNKNOWN_BASE
from ..sources.dictionary import Dictionary

#: Bytes of text that become arrays at a time.
SLICE_BYTES = 1 << 20
#: Words up to which a lexicon is joined by broadcast.
BROADCAST_WORDS = 1 << 20


class Texts:
    """The characters of a batch of texts, one after another."""

    def __init__(self, batch: pa.Array):
        batch = batch.cast(pa.string()).fill_null("") if batch.null_count else batch.cast(pa.string())
        offsets = np.frombuffer(batch.buffers()[1], np.int32, len(batch) + 1, batch.offset * 4).astype(np.int64) if len(batch) else np.zeros(1, np.int64)
        held = batch.buffers()[2]
        data = bytes(memoryview(held)[offsets[0] : offsets[-1]]) if held is not None else b""
        self.data, offsets = data, offsets - offsets[0]
        raw = np.frombuffer(data, np.uint8)
        self.byte = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where each character begins, and the end
        self.codes = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.int32)
        self.first = np.searchsorted(self.byte, offsets)  # of each text, and the end
        sizes = np.diff(self.first)
        self.start, self.end = np.repeat(self.first[:-1], sizes), np.repeat(self.first[1:], sizes)  # of the text of each character
        self.byte_base = np.repeat(offsets[:-1], sizes)

    def lists(self, columns: dict[str, np.ndarray], keep: np.ndarray | None = None) -> pa.ListArray:
        """A list of structs for each text: a value of each column for every character, or for those (ascending) of keep."""
        ends = self.first if keep is None else np.searchsorted(keep, self.first)
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.bool_() if c.dtype == bool else pa.int32()) for c in columns.values()]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(arrays, list(columns)))

    def pos(self) -> np.ndarray:
        return np.arange(len(self.codes)) - self.start

    def characters(self) -> pa.ListArray:
        ch = pa.Array.from_buffers(pa.string(), len(self.codes), [None, pa.py_buffer(self.byte.astype(np.int32)), pa.py_buffer(self.data)])
        columns = {"pos": self.pos(), "ch": ch, "code": self.codes, "byte_start": self.byte[:-1] - self.byte_base, "byte_end": self.byte[1:] - self.byte_base}
        return self.lists(columns)


class Categories:
    """Category lists by code point; list 0 is that of code points without a range."""

    def __init__(self, d: Dictionary):
        edges = sorted({0, *(r.start for r in d.ranges), *(r.end for r in d.ranges)})
        numbers = {(0,): 0}
        self.starts, self.number = np.array(edges), np.array([numbers.setdefault(d.categories_of(e), len(numbers)) for e in edges])
        self.lists = list(numbers)
        self.overlap = np.array([[bool({*a} & {*b}) for b in self.lists] for a in self.lists])

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.starts, codes, "right") - 1]

    def runs(self, texts: Texts, sets: np.ndarray) -> np.ndarray:
        """For each character where its run ends, counted over the batch: for each list, the next character without any of it."""
        out, index = texts.end.copy(), np.arange(len(sets))
        for own in np.unique(sets).tolist():
            ahead = np.minimum.accumulate(np.where(self.overlap[own][sets], len(sets), index)[::-1])[::-1]
            mine = sets == own
            out[mine] = np.minimum(texts.end[mine], ahead[mine])
        return out


class Surfaces:
    """The distinct surfaces of a lexicon, numbered in order; finds them at every place by hashes of each length, then exactly."""

    def __init__(self, surfaces: list[str]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        codes = {}
        for number, w in enumerate(surfaces):
            if w:
                codes.setdefault(len(w), []).append((np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32), number))
        for n, own in codes.items():
            table, numbers = np.stack([c for c, _ in own]), np.array([k for _, k in own])
            hashes = self._hashes(table.T)
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = hashes[order], table[order], numbers[order]

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def _hashes(self, columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * self._ODD
        return out

    def find(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character, length and number of every surface in every place, by character."""
        found, n = [], len(texts.codes)
        upto, hashes = 0, np.zeros(n, np.uint64)
        for length in sorted(self.by_length):
            known, table, numbers = self.by_length[length]
            while upto < length:
                hashes = (hashes[: n - upto] ^ texts.codes[upto:].astype(np.uint64)) * self._ODD
                upto += 1
            lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            at = np.flatnonzero((hi > lo) & (np.arange(len(hashes)) + length <= texts.end[: len(hashes)]))
            for step in range(int((hi - lo)[at].max()) if len(at) else 0):  # more than one for surfaces of one hash only
                own = at[lo[at] + step < hi[at]]
                row = lo[own] + step
                same = (texts.codes[own[:, None] + np.arange(length)] == table[row]).all(axis=1)
                found.append((own[same], np.full(int(same.sum()), length), numbers[row[same]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        at, length, number = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], length[order], number[order]


def _pieces(batch: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of about SLICE_BYTES."""
    n = max(1, len(batch) * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, max(1, len(batch)), n):
        yield batch.slice(at, n)


def text_column(make: Callable[[Texts], pa.Array], kind: str):
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in _pieces(batch):
                yield make(Texts(piece))

    return F.arrow_udf(column, kind)


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, ch, code, byte_start, byte_end): a row for each code point."""
    each = text_column(Texts.characters, "array<struct<pos:int,ch:string,code:int,byte_start:int,byte_end:int>>")
    return df.select(key, F.inline(each(F.col(text)))).select(key, "pos", "ch", "code", "byte_start", "byte_end")


def text_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chars, bytes): where the last character of each text ends; null for null texts."""

    def make(texts: Texts) -> pa.Array:
        sizes = [np.diff(texts.first), np.diff(texts.byte[texts.first])]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in sizes], ["chars", "bytes"])

    own = text_column(make, "struct<chars:int,bytes:int>")(F.col(text))
    return df.select(key, F.when(F.col(text).isNotNull(), own).alias("r")).select(key, "r.*")


def category_ids(code: Column, d: Dictionary) -> Column:
    """The category list of a code point: of the last range with it, else the first category alone."""
    out = F.array(F.lit(0))
    for r in d.ranges:
        out = F.when((code >= r.start) & (code < r.end), F.array(*map(F.lit, r.category_ids))).otherwise(out)
    return out


def with_categories(chars: DataFrame, d: Dictionary) -> DataFrame:
    """chars with category_ids and their first, base."""
    return chars.withColumn("category_ids", category_ids(F.col("code"), d)).withColumn("base", F.col("category_ids")[0])


def surfaces_of(*words) -> list[str]:
    """The distinct surfaces of some entries, in order."""
    return sorted({e.surface for own in words for e in own})


def with_runs(df: DataFrame, key: str, text: str, d: Dictionary) -> DataFrame:
    """(key, pos, code, run_end, matched, category_ids, base) of each character.

    run_end: the first position from which its categories are not shared; matched: whether a word starts there.
    """
    categories, known = Categories(d), Surfaces(surfaces_of(d.entries, d.user))

    def make(texts: Texts) -> pa.Array:
        sets = categories.of(texts.codes)
        matched = np.zeros(len(sets), bool)
        matched[known.find(texts)[0]] = True
        columns = {"pos": texts.pos(), "code": texts.codes, "run_end": categories.runs(texts, sets) - texts.start, "matched": matched, "number": sets}
        return texts.lists(columns)

    each = text_column(make, "array<struct<pos:int,code:int,run_end:int,matched:boolean,number:int>>")
    listed = F.array(*(F.array(*map(F.lit, own)) for own in categories.lists))
    rows = df.select(key, F.inline(each(F.col(text)))).withColumn("category_ids", F.get(listed, F.col("number")))
    return rows.select(key, "pos", "code", "run_end", "matched", "category_ids", F.col("category_ids")[0].alias("base"))


def run_lengths(df: DataFrame, key: str, text: str, d: Dictionary) -> DataFrame:
    """(key, chars, total, longest): the runs of each text's characters, added up and at most; 0 for texts without characters, null for null ones."""
    categories = Categories(d)

    def make(texts: Texts) -> pa.Array:
        size = categories.runs(texts, categories.of(texts.codes)) - np.arange(len(texts.codes))
        some = np.flatnonzero(np.diff(texts.first))
        total, longest = (np.zeros(len(texts.first) - 1, np.int64) for _ in range(2))
        if len(some):
            total[some], longest[some] = np.add.reduceat(size, texts.first[some]), np.maximum.reduceat(size, texts.first[some])
        columns = [pa.array(np.diff(texts.first)), pa.array(total), pa.array(longest.astype(np.int32))]
        return pa.StructArray.from_arrays(columns, ["chars", "total", "longest"])

    own = text_column(make, "struct<chars:bigint,total:bigint,longest:int>")(F.col(text))
    return df.select(key, F.when(F.col(text).isNotNull(), own).alias("r")).select(key, "r.*")


def surface_matches(df: DataFrame, key: str, text: str, surfaces: list[str]) -> DataFrame:
    """(key, start, end, number) of every surface in every place; number: its place in the list."""
    known = Surfaces(surfaces)

    def make(texts: Texts) -> pa.Array:
        at, length, number = known.find(texts)
        start = at - texts.start[at]
        return texts.lists({"start": start, "end": start + length, "number": number}, at)

    return df.select(key, F.inline(text_column(make, "array<struct<start:int,end:int,number:int>>")(F.col(text))))


def surface_table(spark, surfaces: list[str]) -> DataFrame:
    """(number, surface), broadcast while it is small."""
    table = spark.createDataFrame(pa.table({"number": pa.array(range(len(surfaces)), pa.int32()), "surface": pa.array(surfaces, pa.string())}))
    return F.broadcast(table) if len(surfaces) <= BROADCAST_WORDS else table


def known_edges(df: DataFrame, key: str, text: str, d: Dictionary, user: bool = False) -> DataFrame:
    """(key, start, end, word_id, left_id, right_id, word_cost, surface) of every word of the lexicon (or the user's) in every place."""
    words, surfaces = d.tables(df.sparkSession)["user" if user else "lexicon"], surfaces_of(d.user if user else d.entries)
    table = words.join(surface_table(df.sparkSession, surfaces), "surface").select("number", "surface", "word_id", "left_id", "right_id", "word_cost")
    if len(surfaces) <= BROADCAST_WORDS:
        table = F.broadcast(table)
    found = surface_matches(df, key, text, surfaces).join(table, "number")
    return found.select(key, "start", "end", "word_id", "left_id", "right_id", "word_cost", "surface")


def surface_counts(df: DataFrame, key: str, text: str, surfaces: list[str]) -> DataFrame:
    """(surface, n, keys): how often each surface occurs, and in how many distinct keys."""
    found = surface_matches(df, key, text, surfaces).groupBy("number", key).agg(F.count("*").alias("n"))
    counts = found.groupBy("number").agg(F.sum("n").alias("n"), F.count(key).alias("keys"))
    return counts.join(surface_table(df.sparkSession, surfaces), "number").select("surface", "n", "keys")


def unknown_edges(runs: DataFrame, tables: dict[str, DataFrame], key: str, max_grouping: int = 0, fallback: bool = True) -> DataFrame:
    """(key, start, end, word_id, left_id, right_id, word_cost) of every unknown word; runs: characters as with_runs gives them."""
    category = tables["category"].select(F.col("category_id").alias("base"), "invoke", "group", "length")
    at = runs.join(category, "base").where(~F.col("matched") | F.col("invoke"))
    size = F.col("run_end") - F.col("pos")
    grouped = F.col("group") & (F.lit(not max_grouping) | (size - 1 <= max_grouping))
    # the grouped length first, then 1 up to the category's length, without the grouped one again
    singles = F.when(F.least("length", size) >= 1, F.sequence(F.lit(1), F.least("length", size))).otherwise(F.array().cast("array<int>"))
    sizes = F.when(grouped, F.concat(F.array(size), F.filter(singles, lambda n: n != size))).otherwise(singles)
    unknown = tables["unknown"].select("unk_id", F.col("category_id").alias("base"), "left_id", "right_id", "word_cost")
    columns = [key, F.col("pos").alias("start"), "end", "word_id", "left_id", "right_id", "word_cost"]
    sized = at.withColumn("sizes", sizes)
    made = sized.join(unknown, "base").withColumn("n", F.explode("sizes")).withColumn("end", F.col("pos") + F.col("n")).withColumn("word_id", F.col("unk_id") + F.lit(UNKNOWN_BASE)).select(*columns)
    return made.unionByName(fallback_edges(sized, unknown, key)) if fallback else made


def fallback_edges(sized: DataFrame, unknown: DataFrame, key: str) -> DataFrame:
    """One character where nothing else starts: by the first entry of its category, or the general unknown word."""
    first = unknown.groupBy("base").agg(F.min_by(F.struct("unk_id", "left_id", "right_id", "word_cost"), "unk_id").alias("u"))
    alone = sized.where(~F.col("matched")).join(first, "base", "left").where((F.size("sizes") == 0) | F.col("u").isNull())
    return alone.select(
        key, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), (F.lit(UNKNOWN_BASE) + F.coalesce("u.unk_id", F.lit(0))).alias("word_id"), F.coalesce("u.left_id", F.lit(0)).alias("left_id"),
        F.coalesce("u.right_id", F.lit(0)).alias("right_id"), F.coalesce("u.word_cost", F.lit(FALLBACK_COST)).alias("word_cost"),
    )


def space_links(runs: DataFrame, d: Dictionary, key: str) -> DataFrame:
    """(key, pos, run_end) of the characters that ignore-space mode passes over."""
    space = d.category_id("SPACE")
    return runs.where(F.array_contains("category_ids", F.lit(-1 if space is None else space))).select(key, "pos", "run_end")


def edges(df: DataFrame, key: str, text: str, d: Dictionary, max_grouping: int = 0) -> DataFrame:
    """All edges that the kernel may take, ignoring reachability: (key, start, end, word_id, left_id, right_id, word_cost)."""
    known = known_edges(df, key, text, d)
    if d.user:
        known = known.unionByName(known_edges(df, key, text, d, user=True))
    return known.drop("surface").unionByName(unknown_edges(with_runs(df, key, text, d), d.tables(df.sparkSession), key, max_grouping))


def reachable_edges(all_edges: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Edges that start where some chain of edges arrives; positions: (key, start) rows, as a tokenizer's reachable column gives."""
    return all_edges.join(positions, [key, "start"], "left_semi")


def connection_costs(pairs: DataFrame, d: Dictionary) -> DataFrame:
    """pairs (right_id, left_id) with their cost; pairs outside the matrix have a fixed one."""
    m = d.tables(pairs.sparkSession)["connection"]
    return pairs.join(m, ["right_id", "left_id"], "left").withColumn("cost", F.coalesce(F.col("cost").cast("int"), F.lit(OUTSIDE_COST)))


def cheapest_terms(words: DataFrame) -> DataFrame:
    """The least word cost of each (surface, left_id, right_id): words that only counting cannot tell apart."""
    return words.groupBy("surface", "left_id", "right_id").agg(F.min("word_cost").alias("word_cost"))


def undominated_terms(terms: DataFrame, d: Dictionary, on: str = "surface") -> DataFrame:
    """Terms that some word before may make the cheapest of their surface and right id.

    A term goes if another of the same surface and right id costs no more after every right id; of equal ones the one
    of least left id stays. Costs of best paths are unchanged; counts may change where costs tie.
    """
    m = d.tables(terms.sparkSession)["connection"]
    vector = m.groupBy("left_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("right_id", "cost"))), lambda c: c["cost"].cast("long")).alias("costs"))
    t = terms.join(vector, "left_id").withColumn("total", F.transform("costs", lambda c: c + F.col("word_cost"))).drop("costs")
    other = t.select(F.col(on).alias("o_on"), F.col("right_id").alias("o_right"), F.col("left_id").alias("o_left"), F.col("total").alias("o_total"))
    below = F.forall(F.zip_with("o_total", "total", lambda a, b: a <= b), lambda x: x)
    beaten = (F.col("o_on") == F.col(on)) & (F.col("o_right") == F.col("right_id")) & (F.col("o_left") != F.col("left_id")) & below & ((F.col("o_total") != F.col("total")) | (F.col("o_left") < F.col("left_id")))
    return t.join(other, beaten, "left_anti").drop("total")
