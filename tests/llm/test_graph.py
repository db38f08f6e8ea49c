import random
from pathlib import Path

from seglattice.llm.common import shared_dir
from seglattice.llm.graph import components

from .test_simhash import union


def grouped(pairs):
    out = {}
    for node, label in pairs:
        out.setdefault(label, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_components_equal_union_find_wherever_they_are_joined(spark):
    rng = random.Random(4)
    chain = [(-(i + 1), -(i + 2)) for i in range(60)]
    star = [(10**18, 10**18 + i) for i in range(1, 40)]
    edges = chain + star + [(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(90))] + [(7, 7), (1, 2), (2, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = grouped(union(nodes, [e for e in edges if e[0] != e[1]]).items())
    for few in (0, 20, 1000):  # by contraction alone, by both, by the driver alone
        got = components(df, few).collect()
        assert len(got) == len(nodes)
        assert grouped(tuple(r) for r in got) == want
    for few in (0, 1000):
        assert components(df.where("a = b"), few).collect() == []


def test_few_edges_write_one_table(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / spark.sparkContext.applicationId
    before = set(folder.iterdir()) if folder.exists() else set()
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)], "a bigint, b bigint")
    assert {r["label"] for r in components(chain).collect()} == {0}
    assert len(set(folder.iterdir()) - before) == 1
