"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every key (by default the text, so that equal texts start at one place) hashes to one of 2^16 places of a ring on
which each shard owns `vnodes` virtual nodes. Its home is the next virtual node clockwise. A shard takes its own
keys, in ring order, up to its capacity; keys that overflow a full shard continue clockwise to the next shard with
room. Since only the number of keys on each arc matters for that walk, it runs over the arc counts alone (at most
shards x vnodes numbers, whatever the input), and rows find their shard by their rank on their arc. A hot arc is
ranked in many parts, so that no task sorts more than about rows / SPLITS rows.

Defined results: a null text hashes like any other single value; rows that are equal in every column are
interchangeable and get neighbouring slots; an empty table gives an empty result; columns other than the id and
text do not take part.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import defaultdict

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

PLACES = 1 << 16
#: Parts into which a full table is ranked; a constant, so the table of parts does not grow with the input.
SPLITS = 4096


def ring(shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """Arcs (first place, last place, shard) in clockwise order; they cover every place once (the last arc wraps)."""
    owner: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            h = xxhash.xxh64_intdigest(f"{shard}/{replica}", seed=7)
            place = h % PLACES
            owner[place] = min(owner.get(place, (h, shard)), (h, shard))
    places = sorted(owner)
    arcs, first = [], 0
    for place in places:
        arcs.append((first, place, owner[place][1]))
        first = place + 1
    if first < PLACES:
        arcs.append((first, PLACES - 1, owner[places[0]][1]))
    return arcs


def capacities(rows: int, shards: int, load_factor: float | None) -> list[int]:
    """None: shares that differ by one at most and add up to rows; otherwise ceil(load_factor * mean) for each shard."""
    if load_factor is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be 1 or more")
    return [-int(-load_factor * rows // shards)] * shards


def walk(arcs: list[tuple[int, int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): home keys first, then what overflows, clockwise."""
    room, used, pieces, left = list(room), defaultdict(int), [], []

    def put(arc: int, at: int, n: int, shard: int) -> None:
        pieces.append((arc, at, at + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for i, (_, _, shard) in enumerate(arcs):
        n = counts.get(i, 0)
        home = min(n, room[shard])
        if home:
            put(i, 0, home, shard)
        if n > home:
            left.append((i, home, n))
    for i, at, n in left:
        step = i
        while at < n:
            step = (step + 1) % len(arcs)
            shard = arcs[step][2]
            take = min(n - at, room[shard])
            if take:
                put(i, at, take, shard)
                at += take
            elif step == i and not any(room):
                raise ValueError("the shards have less room than there are rows")
    return pieces


def rows_frame(spark, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of integers from one literal: no RDD, no Python on executors."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows_as_objects(schema, rows))), f"array<struct<{schema}>>")))


def rows_as_objects(schema: str, rows: list[tuple]) -> list[dict]:
    names = [part.split(":")[0].strip() for part in schema.split(",")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def assign_shards(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, vnodes: int = 128, load_factor: float | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, home_shard, shard, slot) of every row; slot counts from 0 in each shard without gaps.

    load_factor None fills shards to equal counts (at most one apart); 1 + eps lets shards fill up to that multiple of
    the mean, which moves fewer keys off their home. key: what is hashed, the text by default.
    """
    spark, arcs = docs.sparkSession, ring(shards, vnodes)
    text = F.col(text_col)
    place = F.pmod(F.xxhash64(text if key is None else key), F.lit(PLACES)).cast("int")
    # a fixed 2^16 rows
    by_place = rows_frame(spark, "a:int,b:int,arc:int,home_shard:int", [(a, b, i, s) for i, (a, b, s) in enumerate(arcs)]).select(
        "arc", "home_shard", F.explode(F.sequence("a", "b")).alias("place")
    )
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            place.alias("place"),
        )
        .join(F.broadcast(by_place), "place")
        .drop("place"),
        "shards",
    )
    counts = {r["arc"]: r["n"] for r in narrow.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most len(arcs) rows
    rows = sum(counts.values())
    pieces = walk(arcs, counts, capacities(rows, shards, load_factor))
    parts = [(arc, -(-n * SPLITS // rows)) for arc, n in sorted(counts.items())]
    # both small tables have at most len(arcs) + SPLITS + shards rows, whatever the input
    split = narrow.join(F.broadcast(rows_frame(spark, "arc:int,parts:int", parts)), "arc").withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("parts")).cast("int"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("arc", "part").agg(F.count("*").alias("n")).select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = split.withColumn("row", F.row_number().over(Window.partitionBy("arc", "part").orderBy("doc_id", "text_crc32", "size")))
    placed = F.broadcast(rows_frame(spark, "arc:int,lo:bigint,hi:bigint,shard:int,base:bigint", pieces)).alias("p")
    rank = F.col("offset") + F.col("row") - 1
    return (
        ranked.join(F.broadcast(offsets), ["arc", "part"])
        .withColumn("rank", rank)
        .alias("r")
        .join(placed, (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "size", "text_crc32", "home_shard", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
    )
