"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a given value.

Texts with equal sets share a key. Candidates come from MinHash: BANDS bands of ROWS minima each, so a pair of
similarity s shares no band with probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8; every candidate is then held against the
whole sets of shingle hashes (32 bits each), so no pair below the similarity is linked.

Within a band, up to PAIRS members are compared pair by pair. In a larger bucket the member that shares the most bands
with others (the original of a group of copies) is compared with all others; most groups are one component then. What
a path does not join yet is compared by an exact prefix filter: the shingles of these buckets' members are ordered by
rarity, two sets of the similarity share one of their rarest (of the n shingles of a set, n - ceil(similarity * n) + 1),
and where that one stands bounds how many they can share. So nothing is capped, and members that differ by shingles of
their own meet nobody; only a large bucket of texts that share rare shingles and are yet not similar takes many pairs.

Words and short texts are those of the fingerprint; a text without words has the empty set, similar to its like only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .graph import components, join_hot

SEED = 42
BANDS, ROWS = 32, 4
#: Largest bucket whose members are compared pair by pair.
PAIRS = 32
#: Shingles whose minima are taken at a time.
CHUNK = 1 << 12
#: Members with one shingle that a task compares with all others of it.
BLOCK = 4096
#: Shingles of a set up to which it may be broadcast, if more than 1 / HOT_SETS of all pairs need it.
SMALL_SET, HOT_SETS = 1 << 14, 256

_RANDOM = np.random.default_rng(SEED)
_MIX, _ODD = (_RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_STEP, _BAND = np.uint64(0x9E3779B97F4A7C15), _RANDOM.integers(0, 1 << 64, BANDS, np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; fewer words than a shingle make one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    # hashes one by one: no shingle outlives its hash, however long the text
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), repeat(SEED))
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - width + 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for the minima of each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[None, at : at + CHUNK] ^ _MIX) * _ODD).min(axis=1))
    out = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ (column >> np.uint64(29)) ^ column) * _STEP
    return out ^ (out >> np.uint64(32))


def sketch(text: Column, width: int) -> Column:
    """The key of a text's set, its size and its bands."""

    def sketches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            keys, found, sizes = np.zeros(len(batch), np.uint64), np.zeros((len(batch), BANDS), np.uint64), np.zeros(len(batch), np.int32)
            for i, x in enumerate(batch):
                own = shingles(x.as_py(), width)
                sizes[i] = len(own)
                keys[i], found[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), bands(own)
            listed = pa.ListArray.from_arrays(np.arange(0, found.size + 1, BANDS, np.int32), found.reshape(-1).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes), listed], ["key", "shingles", "bands"])

    return F.arrow_udf(sketches, "struct<key:bigint,shingles:int,bands:array<bigint>>")(text)


def shingle_sets(text: Column, width: int) -> Column:
    """Half of each hash, which is enough to tell the shingles of a few texts apart: two agree by chance once in 2^32."""

    def sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [np.unique(shingles(x.as_py(), width).astype(np.uint32)).view(np.int32) for x in batch]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *found]))

    return F.arrow_udf(sets, "array<int>")(text)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""
    out = pairs = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    total = pairs.count()
    if not total:
        return pairs
    for side in ("a", "b"):
        own = F.col(f"own_{side}")
        uses = pairs.groupBy(side).agg(F.count("*").alias("n"))
        needed = materialize(sets.select(F.col("key").alias(side), F.col("own").alias(f"own_{side}")).join(uses, side), "sides")
        out = join_hot(out, needed, [side], "n", total, share=HOT_SETS, fits=F.size(own) <= SMALL_SET)
    a, b, both = F.size("own_a"), F.size("own_b"), F.size(F.array_intersect("own_a", "own_b"))
    near = (F.least(a, b) >= F.greatest(a, b) * similarity - 1e-6) & (both / (a + b - both) >= similarity)
    return materialize(out.where(near).select("a", "b"), "similar")


def rare_shingles(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(token, n, key, label, place, size): the rarest shingles of each member (key, label) that n > 1 members have.

    A pair of sets of the similarity shares at least one of them.
    """
    held = materialize(sets.join(members, "key").select("key", "label", F.size("own").alias("size"), F.explode("own").alias("token")), "shingles")
    counts = materialize(held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "rarity")
    ranked = join_hot(held, counts.withColumn("df", F.col("n")), ["token"], "n", held.count())
    size = F.col("size")
    upto = size - F.ceil(size * similarity - 1e-6).cast("int") + 1
    # shingles of one member only come first of all, so places are counted from the end and those need no sorting;
    # rows are sorted, which can spill, and no list of a whole set is held
    last = Window.partitionBy("key", "label").orderBy(F.desc("df"), F.desc("token"))
    placed = ranked.withColumn("place", size - F.row_number().over(last)).where(F.col("place") < upto)
    return placed.select("token", F.col("df").alias("n"), "key", "label", "place", "size")


def _prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of every two members (key, label) of different labels whose sets may be similar."""
    rare = materialize(rare_shingles(members, sets, similarity), "rare")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = rare.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    right = rare.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left, right = (d.select("token", "block", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "label", "place", "size"))) for d, side in ((left, "a"), (right, "b")))
    small, great = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    # no shingle before this one in either order is common to both, if it is the first that is
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = most + 1e-6 >= (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity))
    may = (F.col("label_a") != F.col("label_b")) & (F.col("key_a") < F.col("key_b")) & (small >= great * similarity - 1e-6) & enough
    on = (left["token"] == right["token"]) & (left["block"] == right["block"]) & may
    return left.join(right, on).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def similar(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Edges (a, b) between keys; keys: (key, shingles, bands), distinct; sets_of: from some keys to their sets, (key, own)."""
    members = keys.select("key", "shingles", F.explode("bands").alias("band"))
    buckets = materialize(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialize(join_hot(members, buckets.withColumn("size", F.col("n")), ["band"], "n", keys.count() * BANDS), "members")
    sets = sets_of(materialize(shared.select("key").distinct(), "wanted"))
    small, large = shared.where(F.col("size") <= PAIRS), shared.where(F.col("size") > PAIRS)
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similarity - 1e-6
    pairs = small.select("band", F.col("key").alias("a"), F.col("shingles").alias("m")).join(small.select("band", F.col("key").alias("b"), F.col("shingles").alias("n")), "band")
    pairs = pairs.where((F.col("a") < F.col("b")) & near(F.col("m"), F.col("n"))).select("a", "b")
    if large.isEmpty():
        return _verified(pairs, sets, similarity)
    # the originals of large buckets
    reach = large.groupBy("key").agg(F.sum("size").alias("reach"))
    large = materialize(large.join(reach, "key"), "large")
    sizes = large.groupBy("band").agg(F.max("size").alias("n"), F.max(F.struct("reach", "key", "shingles")).alias("pivot"))
    met = join_hot(large.select("band", "key", "shingles"), materialize(sizes, "pivots"), ["band"], "n", large.count())
    edges = _verified(pairs.unionByName(met.where(near(F.col("shingles"), F.col("pivot.shingles"))).select(F.col("key").alias("a"), F.col("pivot.key").alias("b"))), sets, similarity)
    # buckets that are not one component yet
    labels = components(edges)
    live = large.join(labels, large["key"] == labels["node"], "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    live = materialize(live, "live")
    open_ = live.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "n")
    left = join_hot(live, materialize(open_, "open"), ["band"], "n", live.count()).select("key", "label").distinct()
    return edges.unionByName(_verified(_prefix_pairs(materialize(left, "left"), sets, similarity), sets, similarity))
