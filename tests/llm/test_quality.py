import zlib
from itertools import product

import numpy as np
import pytest

from seglattice.llm.quality import Field, drop_low_quality, features, fit, gradient, lines_of, lines_udf, quality, train

SF = "/root/testdata/sf0.01"


def brute(unary, turn):
    """The marginal of each label 1 and the log of the sum over all labelings."""
    weight = {}
    for ys in product((0, 1), repeat=len(unary)):
        weight[ys] = np.exp(sum(u * y for u, y in zip(unary, ys, strict=True)) + sum(turn[a, b] for a, b in zip(ys, ys[1:], strict=False)))
    z = sum(weight.values())
    return [sum(w for ys, w in weight.items() if ys[i]) / z for i in range(len(unary))], np.log(z)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 2, 7, 1, 3]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    x = rng.normal(size=(len(doc), 54))
    model = Field(rng.normal(size=54) / 4, rng.normal(size=(2, 2)))
    got, unary = model.marginals(x, doc), x @ model.weights
    for d in range(len(sizes)):
        np.testing.assert_allclose(got[doc == d], brute(unary[doc == d], model.turn)[0], rtol=1e-9)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    doc = np.repeat([0, 1, 2], [4, 1, 3])
    x, y, cost = rng.normal(size=(8, 54)), rng.integers(0, 2, 8), np.ones(8)
    model = Field(rng.normal(size=54) / 5, rng.normal(size=(2, 2)))

    def likelihood(w, t):
        total = 0.0
        for d in range(3):
            u, own = (x @ w)[doc == d], y[doc == d]
            total += (u * own).sum() + sum(t[a, b] for a, b in zip(own, own[1:], strict=False)) - brute(u, t)[1]
        return total / cost.sum()

    w, t = gradient(model, x, doc, y, cost)
    for i in (0, 10, 53):
        e = np.zeros(54)
        e[i] = 1e-5
        assert abs((likelihood(model.weights + e, model.turn) - likelihood(model.weights - e, model.turn)) / 2e-5 - w[i]) < 1e-6
    for a, b in product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = 1e-5
        assert abs((likelihood(model.weights, model.turn + e) - likelihood(model.weights, model.turn - e)) / 2e-5 - t[a, b]) < 1e-6


def test_lines_and_features():
    texts = ["ab cd\n\n  \r\nEF!! EF!!\nab cd", None, "", "\n\n", "é|é"]
    joined, starts, ends, doc, n = lines_of(texts)
    assert n == 5 and [bytes(joined[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab cd", "EF!! EF!!", "ab cd", "é|é"]
    assert doc.tolist() == [0, 0, 0, 4]
    x = features(joined, starts, ends, doc)
    assert x[:, 0].tolist() == [0, 1, 0, 0] and x[:, 10].tolist() == [0, 0.5, 0, 0] and x[:, 12].tolist() == [0, 0, 1, 0]
    np.testing.assert_allclose(x[0, 34:51], x[1, :17])  # the next line's features
    for i, t in enumerate(texts):  # a text's features do not depend on its batch
        own = lines_of([t])
        np.testing.assert_allclose(features(*own[:4]), x[doc == i])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_rows(tables):
    docs, labels = tables
    rows = quality(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_never_used(tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = train(docs, labels), train(docs, flipped)
    assert (a.weights == b.weights).all() and (a.turn == b.turn).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_a_bad_part_of_a_document(spark):
    good, bad = "The tree of thing and then there was more.", "ABC!! DEF!! ABC!! DEF!! ABC!! DEF!!"
    model = fit([("\n".join([good[: 20 + i % 20]] * (1 + i % 5)), 1) for i in range(200)] + [("\n".join([bad[: 20 + i % 15]] * (1 + i % 5)), 0) for i in range(200)])
    low, mixed, high = model.shares(["\n".join([bad] * 6), "\n".join([bad] * 3 + [good] * 3), "\n".join([good] * 6)])
    assert low < 0.2 < mixed < 0.8 < high
    rows = spark.createDataFrame([("\n".join([bad] * 3 + [good] * 3),), (None,)], "t string").select(lines_udf(spark.sparkContext.broadcast(model))("t").alias("l")).collect()
    assert [x["good"] > 0.5 for x in rows[0]["l"]] == [False] * 3 + [True] * 3 and rows[1]["l"] == []


def test_odd_rows(tables, odd_docs, no_docs):
    docs, labels = tables
    model = train(docs, labels)
    rows = quality(odd_docs, labels, model=model).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    kept = drop_low_quality(odd_docs, labels, model=model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality(no_docs, labels, model=model).collect() == []
    assert [r[0] for r in quality(docs, labels.limit(0)).select("score").distinct().collect()] == [0.5]
