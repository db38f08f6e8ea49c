"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of SHINGLE words, XXH64 (seed 42) of each; a bit
is 1 if more than half the shingles have it. Two fingerprints link at RADIUS or fewer differing bits.

Covering: bit i carries one of the 2^(r+1) - 1 nonzero vectors of r+1 bits, and table v keeps the bits whose vector has
an odd product with v. Any r differing bits span at most r dimensions, so some v is orthogonal to all of them, and the
pair agrees on every bit that table v keeps: no pair within the radius is missed.

Equal fingerprints collapse first. Within a bucket of a table, up to PAIRS members are compared directly; beyond that,
each member visits itself and its one-bit neighbours over the bits that the table leaves free, and members that meet
at a point (at most 65) join in a star: two members differ by at most 2 bits exactly if they meet, so nothing is
capped and no pairs of a large bucket are listed.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; component_id is the least id reachable (null ids do not count; null if there is no other); repeated
rows are rows of one group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, number_filter, quoted
from .graph import components, join_hot
from .jaccard import shingle_sets, similar, sketch

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Largest bucket whose members are compared pair by pair.
PAIRS = 32
#: Hashes that are unpacked to bits at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)], repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array(np.fromiter((fingerprint(x.as_py()) for x in batch), np.uint64, len(batch)).view(np.int64))


def simhash(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.arrow_udf(fingerprints, "bigint")(text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bits that each table keeps."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp); their transitive closure holds every pair within RADIUS."""
    masks = covering_masks()
    members = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for v, m in enumerate(masks)))).alias("t")).select("fp", "t.*")
    buckets = materialize(members.groupBy("table", "kept").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = prints.count() * len(masks)
    shared = materialize(join_hot(members, buckets.withColumn("size", F.col("n")), ["table", "kept"], "n", total), "members")
    small, large = shared.where(F.col("size") <= PAIRS).drop("size"), shared.where(F.col("size") > PAIRS)
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["table", "kept"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    free = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks)), F.col("table") + 1)
    points = large.select("table", "fp", F.explode(free).alias("flip")).select("table", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("table", "point").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    stars = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a != b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp")), "prints")
    total = prints.count()
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes.select("fp")))
    known = materialize(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label")), "known")
    groups = known.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    owner = join_hot(known, groups, ["label"], "size", total).select("fp", "n", "component_id")
    return join_hot(prints, materialize(owner, "owners"), ["fp"], "n", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int | None = None, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, one of least id (null ids come last), with all its columns.

    With a width, texts whose sets of shingles of that many words are similar (Jaccard) are linked besides those whose
    fingerprints are.
    """
    # id and text hash name a row up to copies, which are of one group; an id alone may be null or shared
    name, body, text_hash = fresh(docs, "id"), fresh(docs, "body"), fresh(docs, "text_hash")
    text = F.col(quoted(text_col))
    prints = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("body"), simhash(text).alias("fp"), *([sketch(text, width).alias("s")] if width else []))
    prints = materialize(prints.select("id", "body", "fp", *(["s.key", "s.shingles", "s.bands"] if width else [])), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("first")
    nodes = materialize(prints.groupBy("fp").agg(first), "nodes")
    edges = links(nodes.select("fp"))
    if width:
        edges = edges.unionByName(_similar_prints(docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text")), prints, width, similarity))
    labels = components(edges)
    known = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("first", F.coalesce("label", "fp").alias("label"))
    kept = materialize(known.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias(name), F.col("first.body").alias(body)), "kept")
    # rows that are surely kept, and alone, need no join; the others are shuffled by id and text, never broadcast
    counts = prints.groupBy("id", "body").agg(F.count("*").alias("n"))
    chosen = kept.withColumn("chosen", F.lit(True))
    state = counts.join(chosen.hint("shuffle_hash"), counts["id"].eqNullSafe(chosen[name]) & (counts["body"] == chosen[body]), "left").select("id", "body", "n", "chosen")
    state = materialize(state.where("chosen IS NULL OR n > 1"), "doubtful")
    doubtful = number_filter(state.select(F.xxhash64("id", "body")))(F.xxhash64(F.col(quoted(id_col)), F.xxhash64(text)))
    same = F.col(quoted(id_col)).eqNullSafe(F.col(name)) & (F.col(text_hash) == F.col(body))
    out = docs.where(doubtful).withColumn(text_hash, F.xxhash64(text)).join(kept.hint("shuffle_hash"), same, "left_semi")
    if not state.where("chosen").isEmpty():  # copies of a kept row: one stays
        out = out.dropDuplicates([id_col, text_hash])
    columns = list(map(quoted, docs.columns))
    return docs.where(~doubtful).select(*columns).unionByName(out.select(*columns))


def _similar_prints(docs: DataFrame, prints: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints of texts with similar sets of shingles; docs: (id, text)."""
    first = F.min(F.struct("id", "body", "fp")).alias("first")
    keys = materialize(prints.groupBy("key").agg(first, F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands")).select("key", "shingles", "bands", "first.*"), "keys")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of some keys, each from one row of docs."""
        at = keys.join(wanted, "key", "left_semi").select("key", F.col("id").alias("_id"), F.col("body").alias("_body"))
        at = materialize(at, "first")
        among = number_filter(at.select(F.xxhash64("_id", "_body")))
        some = docs.where(among(F.xxhash64("id", F.xxhash64("text"))))
        held = some.withColumn("body", F.xxhash64("text")).join(at.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")))
        sets = materialize(held.select("key", shingle_sets(F.col("text"), width).alias("own")), "sets")
        return sets if sets.count() == wanted.count() else materialize(sets.dropDuplicates(["key"]), "sets")

    print_of = keys.select("key", "fp")
    found = similar(keys.select("key", "shingles", "bands"), sets_of, similarity)
    found = found.join(print_of.withColumnsRenamed({"key": "a", "fp": "x"}), "a").join(print_of.withColumnsRenamed({"key": "b", "fp": "y"}), "b").select("x", "y")
    # sets may be equal where fingerprints, which count repeated shingles, are not
    alike = prints.select("key", F.col("fp").alias("y")).distinct().join(print_of.withColumnRenamed("fp", "x"), "key").select("x", "y")
    return found.unionByName(alike).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
