"""Helpers shared by the training-data operators: tables, shared storage, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow kernel works on at a time; bounds its Python objects.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seglattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder; for when its results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    have, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in have:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive pieces of a string array of about limit bytes each (one row at least), whole rows, in order."""
    n, start, held = len(texts), 0, 0
    if not n:
        yield texts
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i in range(n):
        if i > start and held + lengths[i] > limit:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += int(lengths[i])
    yield texts.slice(start)


#: Bits of the filter below: 4 MB, however many numbers it holds.
FILTER_BITS = 1 << 25


def number_filter(numbers: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """Whether a number may be among those of a table of one bigint column: a Bloom filter of one hash and a fixed size.

    It says yes for all of them and for others as far as it is full; so it spares wide rows a shuffle where few are
    wanted, and changes no result of the join that follows. At most bits / 64 numbers reach the driver.
    """
    placed = numbers.select(F.pmod(F.col(numbers.columns[0]), F.lit(bits)).alias("place"))
    words = placed.groupBy((F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    table, found = np.zeros(bits // 64, np.int64), words.toArrow()
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = numbers.sparkSession.sparkContext.broadcast(table)

    def among(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in columns:
            at = batch.to_numpy(zero_copy_only=False) % bits
            yield pa.array((own[at >> 6] >> (at & 63) & 1).astype(bool))

    return F.arrow_udf(among, "boolean")


def crc_mod(id_column, modulus: int):
    """crc32 of the id as text, modulo: the contract's split of labelled rows."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus
