import random
from collections import Counter

from pyspark.sql import functions as F

from seglattice.llm.jaccard import rare_shingles


def test_rare_shingles_equal_sorted_sets(spark):
    rng = random.Random(6)
    own = {k: sorted(rng.sample(range(-40, 40), rng.randrange(1, 20)) + [1000 * k + i for i in range(rng.randrange(4))]) for k in range(1, 30)}
    df = Counter(t for s in own.values() for t in s)
    want = []
    for key, tokens in own.items():
        size = len(tokens)
        upto = next(n for n in range(1, size + 1) if n == size - -(-size * 4 // 5) + 1)
        want += [(t, df[t], key, key % 3, place, size) for place, t in enumerate(sorted(tokens, key=lambda t: (df[t], t))[:upto]) if df[t] > 1]
    sets = spark.createDataFrame(list(own.items()), "key bigint, own array<int>")
    got = rare_shingles(sets.select("key", (F.col("key") % 3).alias("label")), sets, 0.8)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sets_are_sorted_not_collected(spark):
    """A list of each of many long sets at once is more than a task's memory."""
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "key bigint, own array<int>")
    plan = rare_shingles(sets.select("key", F.col("key").alias("label")), sets, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "collect_list" not in plan
