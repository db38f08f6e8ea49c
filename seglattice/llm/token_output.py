"""Token-id output as wavelet matrices: one compressed blob of succinct bit planes per shard.

A wavelet matrix of ids below 2^L keeps L bit planes. Plane k holds bit L-1-k of every id, in the order that sorting
stably by the bits above gives; counts of ones before every block of 64 bits give rank in one step and select by
binary search. `access`, `count` and `locate` (occurrences of an id in a range) run on the planes; `decode` undoes the
sorts, plane by plane, for whole shards. On disk each plane is compressed by itself; rank counts are rebuilt on load.

`write_tokens` puts documents in ascending id order into range partitions of about SHARD_BYTES of text, encodes each and
writes segments of at most SEGMENT_TOKENS ids (one document at least) as rows (shard, segment, doc_ids, lengths,
wavelet) of a Parquet folder in shared storage; `read_tokens` reads them back. Rows of one id, null among them, are
ordered by a hash of their text and then by their number, so that a hot id is spread over shards like any other rows. A
lost task repeats its own shard only.

Defined results: null and empty texts have the end id alone; null document ids come first; repeated ids keep their
rows, in any order among themselves; an empty table gives an empty folder; further columns do not matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Encoder, Vocabulary, byte_chars, encoder_factory
from .common import quoted, shared_dir, slices

END_ID = 2
SEGMENT_TOKENS = 1 << 20
#: Bytes of text of a shard, on average.
SHARD_BYTES = 32 << 20
#: Shards whose sizes are added up together, before those of groups are.
GROUP = 1024
_MAGIC = b"WVMX0001"


def _select(ones_before: np.ndarray, words: np.ndarray, k: np.ndarray, bit: int) -> np.ndarray:
    """The position of the k-th (from 0) bit of this value."""
    before = ones_before if bit else (np.arange(len(ones_before)) * 64) - ones_before
    block = np.searchsorted(before, k, "right") - 1
    bits = np.unpackbits(words[block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
    upto = np.cumsum(bits, axis=1, dtype=np.int64)
    return block * 64 + (upto > (k - before[block])[:, None]).argmax(axis=1)


class WaveletMatrix:
    """Ids with rank and select on succinct bit planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        """planes: 64-bit words, bit i of the plane in word i // 64."""
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)
        self.before = [np.append(0, np.cumsum(np.bitwise_count(p), dtype=np.int64)) for p in planes]

    @staticmethod
    def planes_of(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Bit planes (as bytes) and the number of zero bits of each."""
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 0
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(levels - 1, -1, -1):
            ones = (ids >> k & 1).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = ids[~ones]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[ones]])
        return planes, zeros

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        return cls.from_bytes(cls.pack(ids))

    @classmethod
    def pack(cls, ids: np.ndarray) -> bytes:
        """The compressed form of ids."""
        planes, zeros = cls.planes_of(ids)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [squeeze(p.tobytes()) for p in planes]
        head = _MAGIC + struct.pack("<qi", len(ids), len(planes)) + struct.pack(f"<{len(planes)}q", *zeros) + struct.pack(f"<{len(planes)}q", *map(len, parts))
        return head + b"".join(parts)

    @staticmethod
    def unpack(blob: bytes) -> tuple[list[np.ndarray], list[int], int]:
        """Bit planes as bytes, zeros and the number of ids."""
        if blob[:8] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<qi", blob, 8)
        zeros, sizes = list(struct.unpack_from(f"<{levels}q", blob, 20)), struct.unpack_from(f"<{levels}q", blob, 20 + 8 * levels)
        at, planes, expand = 20 + 16 * levels, [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            planes.append(np.frombuffer(expand(blob[at : at + size]), np.uint8))
            at += size
        if at != len(blob):
            raise ValueError("truncated wavelet matrix")
        return planes, zeros, n

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        planes, zeros, n = cls.unpack(blob)
        room = -(-(n + 1) // 64) * 8
        return cls([np.append(p, np.zeros(room - len(p), np.uint8)).view(np.uint64) for p in planes], zeros, n)

    @classmethod
    def decode(cls, blob: bytes) -> np.ndarray:
        """All ids in order, by undoing the stable sorts from the lowest plane up."""
        planes, zeros, n = cls.unpack(blob)
        ids = np.zeros(n, np.uint16 if len(planes) <= 16 else np.uint32)
        for k, (plane, zero) in enumerate(zip(reversed(planes), reversed(zeros), strict=True)):
            ones = np.unpackbits(plane, count=n, bitorder="little").view(bool)
            back = np.empty_like(ids)
            back[~ones] = ids[:zero]
            back[ones] = ids[zero:] | ids.dtype.type(1 << k)
            ids = back
        return ids

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of plane k."""
        at = np.asarray(at, np.int64)
        word = self.planes[k][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[k][at >> 6] + np.bitwise_count(word)

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the sequence")
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._rank(k, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.levels or token < 0:
            return 0, 0
        ends = np.array([start, end])
        for k in range(self.levels):
            ones = self._rank(k, ends)
            ends = self.zeros[k] + ones if token >> (self.levels - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs at positions from start up to end."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Where the id occurs at positions from start up to end, in order: select from the lowest plane up."""
        a, b = self._range(token, start, self.n if end is None else end)
        at = np.arange(a, b, dtype=np.int64)
        if not len(at):
            return at
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            at = _select(self.before[k], self.planes[k], at - self.zeros[k] * bit, bit)
        return at


SEGMENTS = "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, wavelet binary"


def _segment_batch(shard: int, segment: int, doc_ids: list, lengths: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    blob = WaveletMatrix.pack(np.concatenate(ids) if ids else np.zeros(0, np.int32))
    columns = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_ids", "lengths", "wavelet"])


def segments_kernel(make: Callable[[], Encoder], end_id: int, segment_tokens: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = make(), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, total = [], [], [], 0
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for piece in slices(batch.column(1)):
                ids, ends = encoder.encode(piece.to_pylist())
                starts = np.append(0, ends[:-1])
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    if lengths and total + b - a + 1 > segment_tokens:
                        yield _segment_batch(shard, number, doc_ids, lengths, held)
                        doc_ids, lengths, held, total, number = [], [], [], 0, number + 1
                    doc_ids.append(next(names))
                    lengths.append(b - a + 1)
                    held += [ids[a:b], np.array([end_id], np.int32)]
                    total += b - a + 1
        if lengths:
            yield _segment_batch(shard, number, doc_ids, lengths, held)

    return segments


def write_tokens(
    docs: DataFrame, vocabulary_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Encode every text, append the end id, and write the ids in ascending document order to a folder of segments."""
    spark = docs.sparkSession
    make = encoder_factory(spark, vocabulary_path, whole_words(vocabulary_path))
    own = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    placed = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    placed.mapInArrow(segments_kernel(make, end_id, segment_tokens), SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def whole_words(vocabulary_path: str) -> list[str]:
    """The words that are one token of the vocabulary."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    place = {c: i for i, c in enumerate(byte_chars())}
    out = []
    for name in vocabulary.names:
        text = name.decode()
        if text.endswith(vocabulary.end) and len(text) > len(vocabulary.end):
            raw = bytes(place[c] for c in text.removesuffix(vocabulary.end) if c in place)
            try:
                word = raw.decode()
            except UnicodeDecodeError:
                continue
            if word.isalpha() and word == word.lower():
                out.append(word)
    return out


def read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, segment, doc_id, within, n_tokens, ids_crc32): each document of each segment, from its bit planes."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix.decode(row["wavelet"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder of segments; start counts all ids before it."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    # running totals of segments in a shard, of shards in a group and of groups, the last of one row for GROUP shards
    sizes = stored.select("shard", "segment", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, n: total + n).alias("size"))
    group = F.floor(F.col("shard") / GROUP).cast("int")
    per_shard = sizes.groupBy("shard").agg(F.sum("size").alias("size")).withColumn("group", group)
    before = lambda *keys: F.sum("size").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("size")
    groups = per_shard.groupBy("group").agg(F.sum("size").alias("size")).select("group", before("group").alias("group_start"))
    shard_start = per_shard.withColumn("in_group", before("group", "shard")).join(groups, "group").select("shard", (F.col("group_start") + F.col("in_group")).alias("shard_start"))
    base = sizes.withColumn("in_shard", before("shard", "segment")).join(shard_start, "shard").select("shard", "segment", (F.col("in_shard") + F.col("shard_start")).alias("base"))
    read = stored.select("shard", "segment", "doc_ids", "lengths", "wavelet").mapInArrow(read_kernel, "shard int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """Write the ids of all texts to shared storage, read the files back, and return what they hold of each document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary_path, path, **options)
    return read_tokens(spark, path)
