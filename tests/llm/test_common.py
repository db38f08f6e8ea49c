import zlib
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seglattice.llm.common import crc_mod, fresh, materialize, number_filter, quoted, release, shared_dir, slices


def test_tables_are_written_and_released(spark):
    df = spark.range(10).withColumn("a b`c", F.lit("x"))
    kept = materialize(df, "kept")
    assert sorted(map(tuple, kept.collect())) == [(i, "x") for i in range(10)] and kept.dtypes == df.dtypes
    assert kept.inputFiles()[0].startswith(shared_dir(spark))
    assert kept.select(quoted("a b`c")).columns == ["a b`c"]
    assert release(spark) and not release(spark)


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([(1, 2)], "_X int, __x int"), "x") == "___x"


def test_slices_hold_every_row_in_order():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c", "é" * 30, None])
    for limit in (1, 12, 60, 1000):
        parts = list(slices(texts, limit))
        assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist()
        assert all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= limit for p in parts)
    assert [len(p) for p in slices(texts.slice(0, 0))] == [0]
    assert [x for p in slices(texts.slice(2, 3), 5) for x in p.to_pylist()] == ["", "b" * 100, "c"]


def test_folds(spark):
    rows = spark.range(50).select("id", crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_a_cluster_without_a_shared_folder_is_an_error():
    def session(master):
        held = {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: held.get(k, d), set=held.__setitem__), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    own = session("local[2]")
    assert shared_dir(own).startswith("file:///") and shared_dir(own) == shared_dir(own)


def test_number_filter_misses_nothing(spark):
    numbers = [-(1 << 63), (1 << 63) - 1, -1, 0, 1, 63, 64, *range(-5000, 5000, 7)]
    wanted = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    others = spark.range(100_000).select((F.xxhash64("id")).alias("n"))
    for bits in (64, 1 << 20):
        among = number_filter(wanted, bits)
        assert wanted.where(among(F.col("n"))).count() == len(numbers)
    assert others.where(among(F.col("n"))).count() < 1000
    assert others.where(number_filter(wanted.limit(0), 1 << 10)(F.col("n"))).count() == 0
