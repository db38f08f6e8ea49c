"""Dictionaries: a lexicon, an optional user lexicon, connection costs, character categories and unknown-word entries.

Sources: one tab-separated text, the four text files of MeCab-style dictionaries (read by Spark, so any file system and
gzip work), a binary file, and a Parquet folder. A dictionary is a small object on the driver; `tables` gives its
DataFrames, and tokenizers broadcast a compiled form.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORY, FALLBACK_COST, FALLBACK_FEATURE, LEXICON, OUTSIDE_COST, RANGE, UNKNOWN, USER_BASE, DictionaryError


@dataclass(frozen=True)
class Entry:
    surface: str
    left_id: int
    right_id: int
    word_cost: int
    feature: str


@dataclass(frozen=True)
class UnknownEntry:
    category_id: int
    left_id: int
    right_id: int
    word_cost: int
    feature: str


@dataclass(frozen=True)
class Category:
    name: str
    invoke: bool
    group: bool
    length: int


@dataclass(frozen=True)
class Range:
    """Code points from start up to end (exclusive) have these categories, the first of them as base."""

    start: int
    end: int
    category_ids: tuple[int, ...]


@dataclass(frozen=True)
class Matrix:
    """Costs by left_id * right_size + right_id."""

    right_size: int
    left_size: int
    costs: np.ndarray

    def cost(self, right_id: int, left_id: int) -> int:
        if right_id >= self.right_size or left_id >= self.left_size:
            return OUTSIDE_COST
        return int(self.costs[left_id * self.right_size + right_id])


@dataclass(frozen=True)
class Dictionary:
    entries: tuple[Entry, ...]
    matrix: Matrix
    categories: tuple[Category, ...]
    ranges: tuple[Range, ...]
    unknown: tuple[UnknownEntry, ...]
    user: tuple[Entry, ...] = field(default=())

    # -- text sources

    @classmethod
    def from_minimal(cls, text: str) -> Dictionary:
        """One text with a matrix and entries; each unmatched character is an unknown word."""
        size, costs, entries, wanted = None, [], [], 0
        for number, raw in enumerate(lines(text), 1):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            parts = line.split("\t")
            if wanted:
                row = [integer(p, -(1 << 15), (1 << 15) - 1, f"matrix cost in line {number}") for p in parts]
                if len(row) != size[1]:
                    raise DictionaryError(f"line {number}: {len(row)} matrix columns where {size[1]} belong")
                costs += row
                wanted -= 1
            elif parts[0] == "matrix" and len(parts) == 3:
                size = tuple(integer(p, 0, 1 << 16, f"matrix size in line {number}") for p in parts[1:])
                costs, wanted = [], size[0]
            elif parts[0] == "entry" and len(parts) == 6:
                entries.append(entry(parts[1:5], parts[5], f"line {number}"))
            else:
                raise DictionaryError(f"line {number} is neither a matrix nor an entry")
        if size is None or wanted or len(costs) != size[0] * size[1]:
            raise DictionaryError("the matrix is missing or short of rows")
        if not entries:
            raise DictionaryError("there are no entries")
        unknown = UnknownEntry(0, 0, 0, FALLBACK_COST, FALLBACK_FEATURE)
        return cls(tuple(entries), Matrix(*size, np.array(costs, np.int16)), (Category("DEFAULT", False, False, 0),), (), (unknown,))

    @classmethod
    def from_mecab_text(cls, lex: str, matrix: str, char: str, unk: str, *, horizontal_bar: bool = False) -> Dictionary:
        """The four texts of a MeCab-style dictionary. horizontal_bar: add an entry for U+2015 where the lexicon has none."""
        categories, ranges = parse_characters(char)
        entries = [entry(r[:4], ",".join(r[4:]), "lexicon") for r in rows(lex, "lexicon")]
        if horizontal_bar and all(e.surface != "―" for e in entries):
            entries.append(Entry("―", 5, 5, 4769, "記号,一般,*,*,*,*,―,―,―"))
        ids = {c.name: i for i, c in reversed(list(enumerate(categories)))}
        unknown = []
        for r in rows(unk, "unknown entries"):
            if r[0] not in ids:
                raise DictionaryError(f"unknown entries: no category {r[0]}")
            e = entry(r[:4], ",".join(r[4:]), "unknown entries")
            unknown.append(UnknownEntry(ids[r[0]], e.left_id, e.right_id, e.word_cost, e.feature))
        out = cls(tuple(entries), parse_matrix(matrix), tuple(categories), tuple(ranges), tuple(unknown))
        check_ids(out.entries, out.matrix, "lexicon")
        check_ids(out.unknown, out.matrix, "unknown entries")
        return out

    @classmethod
    def from_mecab(cls, spark: SparkSession, folder: str, *, lex: str = "lex.csv", matrix: str = "matrix.def", char: str = "char.def", unk: str = "unk.def", encoding: str = "UTF-8", **options) -> Dictionary:
        """The four files in a folder of any file system that Spark reads; lex may be a pattern (files in the order of their names) and gzipped."""
        return cls.from_mecab_text(*(read_text(spark, f"{folder}/{name}", encoding) for name in (lex, matrix, char, unk)), **options)

    @classmethod
    def from_binary(cls, spark: SparkSession, path: str) -> Dictionary:
        """A binary dictionary file of either version, from any file system that Spark reads."""
        from .binary import read_dictionary

        found = spark.read.format("binaryFile").load(path).select("content").take(2)
        if len(found) != 1:
            raise DictionaryError(f"{path} is not one file")
        return read_dictionary(bytes(found[0]["content"]))

    @classmethod
    def builtin(cls) -> Dictionary:
        """A small dictionary for trying things out."""
        return cls.from_mecab_text(BUILTIN_LEX, "1 1\n0 0 0\n", BUILTIN_CHAR, BUILTIN_UNK)

    def with_user_lexicon(self, text: str | None) -> Dictionary:
        """Replace the user lexicon by the rows of this text; None clears it."""
        user = tuple(entry(r[:4], ",".join(r[4:]), "user lexicon") for r in rows(text, "user lexicon")) if text is not None else ()
        check_ids(user, self.matrix, "user lexicon")
        return replace(self, user=user)

    def category_id(self, name: str) -> int | None:
        return next((i for i, c in enumerate(self.categories) if c.name == name), None)

    def categories_of(self, code: int) -> tuple[int, ...]:
        """Those of the last range with the code point, else the first category."""
        return next((r.category_ids for r in reversed(self.ranges) if r.start <= code < r.end), (0,))

    def feature(self, word_id: int) -> str:
        if word_id < USER_BASE:
            return self.entries[word_id].feature
        if word_id < 2 * USER_BASE:
            return self.user[word_id - USER_BASE].feature
        return self.unknown[word_id - 2 * USER_BASE].feature if self.unknown else FALLBACK_FEATURE

    # -- tables

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """lexicon, user, connection, category, range and unknown as DataFrames."""
        m = self.matrix
        left, right = np.divmod(np.arange(len(m.costs), dtype=np.int32), np.int32(m.right_size or 1))
        words = lambda own, base: [(base + i, e.surface, e.left_id, e.right_id, e.word_cost, e.feature) for i, e in enumerate(own)]
        return {
            "lexicon": spark.createDataFrame(words(self.entries, 0), LEXICON),
            "user": spark.createDataFrame(words(self.user, USER_BASE), LEXICON),
            "connection": spark.createDataFrame(pa.table([pa.array(c) for c in (right, left, m.costs.astype(np.int16))], ["right_id", "left_id", "cost"])),
            "category": spark.createDataFrame([(i, c.name, c.invoke, c.group, c.length) for i, c in enumerate(self.categories)], CATEGORY),
            "range": spark.createDataFrame([(i, r.start, r.end, list(r.category_ids)) for i, r in enumerate(self.ranges)], RANGE),
            "unknown": spark.createDataFrame([(i, u.category_id, u.left_id, u.right_id, u.word_cost, u.feature) for i, u in enumerate(self.unknown)], UNKNOWN),
        }

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> Dictionary:
        """The inverse of `tables`."""
        words = lambda df: tuple(Entry(r["surface"], r["left_id"], r["right_id"], r["word_cost"], r["feature"]) for r in df.orderBy("word_id").collect())
        cells = tables["connection"].collect()
        size = [max((c[k] for c in cells), default=-1) + 1 for k in ("right_id", "left_id")]
        costs = np.zeros(size[0] * size[1], np.int16)
        for c in cells:
            costs[c["left_id"] * size[0] + c["right_id"]] = c["cost"]
        return cls(
            words(tables["lexicon"]),
            Matrix(*size, costs),
            tuple(Category(r["name"], r["invoke"], r["group"], r["length"]) for r in tables["category"].orderBy("category_id").collect()),
            tuple(Range(r["start"], r["end"], tuple(r["category_ids"])) for r in tables["range"].orderBy("range_id").collect()),
            tuple(UnknownEntry(r["category_id"], r["left_id"], r["right_id"], r["word_cost"], r["feature"]) for r in tables["unknown"].orderBy("unk_id").collect()),
            words(tables["user"]),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet folder for each table."""
        for name, df in self.tables(spark).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        return cls.from_tables({n: spark.read.parquet(f"{path}/{n}") for n in ("lexicon", "user", "connection", "category", "range", "unknown")})


def prepare_bundle(files: Mapping[str, bytes], encoding: str = "EUC-JP") -> dict[str, bytes]:
    """A dictionary's source files as gzipped UTF-8: its .csv files, in the order of their names, as one lex.csv.gz, each .def file,
    and SHA256SUMS of the plain texts. Equal sources give equal bytes.
    """
    plain = {name: data.decode(encoding) for name, data in sorted(files.items()) if name.endswith(".def")}
    parts = [data.decode(encoding) for name, data in sorted(files.items()) if name.endswith(".csv")]
    if not parts:
        raise DictionaryError("there is no lexicon file")
    plain["lex.csv"] = "".join(p if p.endswith("\n") or not p else p + "\n" for p in parts)
    sums = "".join(f"{hashlib.sha256(text.encode()).hexdigest()}  {name}\n" for name, text in sorted(plain.items()))
    return {**{f"{name}.gz": gzip.compress(text.encode(), mtime=0) for name, text in plain.items()}, "SHA256SUMS": sums.encode()}


# The built-in dictionary.
BUILTIN_LEX = "本,0,0,10,名詞-普通名詞-一般,ホン\nと,0,0,1,助詞-格助詞,ト\nカレー,0,0,10,名詞-普通名詞-一般,カレー\n"
BUILTIN_CHAR = "DEFAULT 1 0 1\nSPACE 1 1 24\nALPHA 1 1 24\nKATAKANA 0 1 24\nEMOJI 1 1 1\n0x0020 SPACE\n0x0041..0x005A ALPHA\n0x0061..0x007A ALPHA\n0x30A0..0x30FF KATAKANA\n0x1F300..0x1FAFF EMOJI\n"
BUILTIN_UNK = "DEFAULT,0,0,10000,*\nSPACE,0,0,10000,空白,\nALPHA,0,0,10000,記号-文字,\nKATAKANA,0,0,10000,名詞-普通名詞-一般,\nEMOJI,0,0,10000,補助記号-一般,\n"


def lines(text: str) -> list[str]:
    """Lines ended by LF or CRLF; no other character ends a line."""
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def integer(text: str, low: int, high: int, what: str) -> int:
    digits = text[1:] if text[:1] in ("+", "-") else text
    if not (digits.isascii() and digits.isdigit()) or not low <= int(text) <= high or text[:1] == "-" and low >= 0:
        raise DictionaryError(f"bad {what}: {text!r}")
    return int(text)


def entry(fields: list[str], feature: str, what: str) -> Entry:
    surface, left, right, cost = fields
    return Entry(surface, integer(left, 0, 0xFFFF, f"left id ({what})"), integer(right, 0, 0xFFFF, f"right id ({what})"), integer(cost, -(1 << 31), (1 << 31) - 1, f"word cost ({what})"), feature)


def rows(text: str, what: str) -> Iterable[list[str]]:
    """CSV rows of five fields or more; rows of an empty surface are passed over and take no word id."""
    for r in csv.reader(io.StringIO(text, newline="")):
        if not r:
            continue
        if len(r) < 5:
            raise DictionaryError(f"{what}: a row of fewer than five fields: {r}")
        if r[0]:
            yield r


def parse_matrix(text: str) -> Matrix:
    filled = [s for s in (line.split() for line in lines(text)) if s]
    if not filled or len(filled[0]) != 2:
        raise DictionaryError("the matrix has no header of two sizes")
    right_size, left_size = (integer(s, 0, 1 << 16, "matrix size") for s in filled[0])
    costs = np.zeros(right_size * left_size, np.int16)
    for f in filled[1:]:
        if len(f) != 3:
            raise DictionaryError(f"bad matrix row: {' '.join(f)}")
        right, left, cost = integer(f[0], 0, right_size - 1, "right id"), integer(f[1], 0, left_size - 1, "left id"), integer(f[2], -(1 << 15), (1 << 15) - 1, "matrix cost")
        costs[left * right_size + right] = cost
    return Matrix(right_size, left_size, costs)


def parse_range(text: str) -> tuple[int, int]:
    """First and last code point in hexadecimal, or one of them; the end returned is exclusive."""
    parts = text.split("..")
    try:
        ends = []
        for p in parts:
            while p.startswith("0x"):
                p = p[2:]
            if not p.isalnum() or not p.isascii():
                raise ValueError
            ends.append(int(p, 16))
    except ValueError:
        raise DictionaryError(f"bad code point range: {text}") from None
    if len(parts) > 2 or ends[0] > ends[-1]:
        raise DictionaryError(f"bad code point range: {text}")
    return ends[0], ends[-1] + 1


def parse_characters(text: str) -> tuple[list[Category], list[Range]]:
    categories: list[Category] = []
    ranges: list[Range] = []
    for raw in lines(text):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        parts = line.split()
        if not line.startswith("0x"):
            if len(parts) < 4 or parts[1] not in "01" or parts[2] not in "01":
                raise DictionaryError(f"bad character category: {line}")
            categories.append(Category(parts[0], parts[1] == "1", parts[2] == "1", integer(parts[3], 0, 1 << 62, "category length")))
            continue
        if len(parts) < 2:
            raise DictionaryError(f"bad character range: {line}")
        start, end = parse_range(parts[0])
        named = []
        for p in parts[1:]:
            if p.startswith("#"):
                break
            found = next((i for i, c in enumerate(categories) if c.name == p), None)
            if found is None:
                raise DictionaryError(f"no category {p} before its use: {line}")
            named.append(found)
        if not named:
            raise DictionaryError(f"bad character range: {line}")
        ranges.append(Range(start, end, tuple(named)))
    if all(c.name != "DEFAULT" for c in categories):
        raise DictionaryError("there is no category DEFAULT")
    return categories, ranges


def check_ids(entries: Iterable[Entry | UnknownEntry], matrix: Matrix, what: str) -> None:
    bad = [e for e in entries if e.left_id >= matrix.left_size or e.right_id >= matrix.right_size]
    if bad:
        raise DictionaryError(f"{what}: connection ids outside the matrix, first in {bad[0]}")


def invalid_ids(words: DataFrame, connection: DataFrame) -> DataFrame:
    """Rows of a lexicon or of unknown entries whose connection ids are outside the matrix."""
    size = connection.agg(F.max("right_id").alias("max_right"), F.max("left_id").alias("max_left")).first()
    outside = lambda c, most: F.col(c) > (-1 if most is None else most)
    return words.where(outside("right_id", size["max_right"]) | outside("left_id", size["max_left"]))


def read_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """Whole files as text, joined in the order of their names; gzip by extension."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").collect()
    texts = [(gzip.decompress(bytes(f["content"])) if f["path"].endswith(".gz") else bytes(f["content"])).decode(encoding) for f in files]
    return texts[0] if len(texts) == 1 else "".join(t.rstrip("\n") + "\n" for t in texts if t.strip("\n"))
