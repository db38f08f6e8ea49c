import zlib
from itertools import combinations

import numpy as np
import pytest

from seglattice.llm.toxicity import DECAY, END, HELD, ORDER, TOP, Model, Scorer, drop_toxic, fit, kernel, labelled_sample, matrix, parts_of, pivots, raw_kernel, tokens, toxicity, train, unit_pieces, units

SF = "/root/testdata/sf0.01"


def slow_kernel(s, t):
    """Every pair of equal subsequences."""

    def phi(x):
        out = {}
        for at in combinations(range(len(x)), ORDER):
            z = "".join(x[i] for i in at)
            out[z] = out.get(z, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = phi(s), phi(t)
    return sum(v * b.get(z, 0) for z, v in a.items())


WORDS = ["idiot", "idiots", "xidxixoxt", "banana", "aaaa", "ñandú", "ab", "", "the", "🍛🍛🍛a"]


def test_kernel_equals_enumeration():
    got = raw_kernel(matrix(WORDS, -1), matrix(WORDS, -2))
    want = [[slow_kernel(s, t) for t in WORDS] for s in WORDS]
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-6)
    k = kernel(WORDS, WORDS)
    own = [slow_kernel(s + END, s + END) if len(s) >= ORDER else 0 for s in WORDS]
    want = [[slow_kernel(s + END, t + END) / (a * b) ** 0.5 if a and b else 0 for t, b in zip(WORDS, own)] for s, a in zip(WORDS, own)]
    np.testing.assert_allclose(k, want, rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(np.diag(k), [1, 1, 1, 1, 1, 1, 0, 0, 1, 1], atol=1e-4)
    assert k[0, 2] > 5 * k[0, 3]


def test_margins_equal_the_landmark_sum():
    model = Model(["idiot", "banana", "ñandú"], np.array([1.5, -0.7, 0.3]), -0.2, 1.0, 0.0)
    want = kernel(WORDS, model.landmarks) @ model.weights + model.bias
    np.testing.assert_allclose(model.margins(WORDS), want, atol=1e-4)


def test_units():
    assert units("The (Idiot), bc! w-o-w --") == {"the", "idiot", "bc", "w-o-w", "wow"}
    assert "idiot" in units("an i d i o t yes") and "idiot" in units("an i . d i * o t") and "idiot" in units("i d i o t")
    assert "ab" not in units("a b cd") and "abc" in units("x-y a b c de")
    assert units(None) == units("") == units(" .. !") == set()
    long = "".join(chr(97 + i % 26) for i in range(100))
    assert all(any(long[i : i + 12] in u for u in units(long)) for i in range(88))


def test_large_alphabets_give_the_same_kernel(monkeypatch):
    k = kernel(WORDS, WORDS)
    monkeypatch.setattr("seglattice.llm.toxicity.DENSE", 0)
    np.testing.assert_allclose(kernel(WORDS, WORDS), k)


def test_pivots_explain_the_others():
    words = [f"{a}{b}" for a in ("idiot", "banana", "worth") for b in ("", "s", "ic", "less")]
    some = pivots(words, 6)
    assert len(set(some)) == 6 and some[0] == words[0]
    for i in range(1, 6):  # each is the one that those before explain least
        k, own = kernel(words, some[:i]), kernel(some[:i], some[:i])
        rest = 1 - np.einsum("ij,jk,ik->i", k, np.linalg.inv(own), k)
        assert rest[words.index(some[i])] >= rest.max() - 1e-4


def test_split_insults_are_joined():
    parts = parts_of(["idiot", "worthless"])
    assert "idiot" in units("an id iot, yes", parts) and "worthless" in units("wor th less.", parts)
    assert units("the id of iota", parts) == units("the id of iota")
    assert units("id", parts) == {"id"} and units(None, parts) == set()


def test_scorer_takes_the_largest_margins_of_all_units():
    model = Model(["idiot", "banana", "ñandú"], np.array([1.5, -0.7, 0.3]), -0.2, np.ones(2), 0.0, parts_of(["idiot"]))
    texts = ["the (idiot)!", "a - b", "id-iot, ban", "«ñandú» x", "i d i o t", "x" * 60 + "idiot", "", "__ ..", "$$$banana### 7", "id iot idiot Idiot. the tree"]
    got = Scorer(model).margins(texts)
    for text, row in zip(texts, got):
        own = [max(model.margins(unit_pieces(t)).tolist(), default=model.bias) for t in tokens(text, model.parts)]
        want = sorted(set(np.round(own, 4)), reverse=True)[:TOP] or [model.bias] * TOP
        np.testing.assert_allclose(row, want + [HELD[0]] * (TOP - len(want)), atol=2e-4)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_rows(spark, tables):
    docs, labels = tables
    rows = toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def inserted(w):
    return [w[:i] + c + w[i:] for i in range(1, len(w)) for c in "aeioxqz"]


def test_recall_precision_and_disguises(spark):
    """On sf0.1: held-out recall and precision, and the insults that toxic documents often have and clean ones never."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = train(docs, labels)
    rows = toxicity(docs, labels, model=model).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()

    def recall_precision(own):
        hit = sum(r["predicted"] and r["toxic"] for r in own)
        return hit / sum(r["toxic"] for r in own), hit / sum(r["predicted"] for r in own)

    recall, precision = recall_precision(rows)
    assert recall >= 0.9 and precision >= 0.9
    for lang in ("en", "de", "fr", "es"):
        assert min(recall_precision([r for r in rows if r["lang"] == lang])) >= 0.6
    score = lambda words: model.probability(Scorer(model).margins([f"you are {w} ok" for w in words]))
    insults = ["idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown"]
    assert (score(insults) >= 0.5).all()
    forms = {
        "inserted": [v for w in insults for v in inserted(w)],
        "doubled": [w[:i] + w[i - 1 :] for w in insults for i in range(1, len(w) + 1)],
        "dropped": [w[:i] + w[i + 1 :] for w in insults for i in range(len(w))],
        "split": [f"{w[:i]} {w[i:]}" for w in insults for i in range(1, len(w))],
    }
    caught = {k: (score(v) >= 0.5).mean() for k, v in forms.items()}
    assert min(caught.values()) >= 0.95, caught
    assert (score(["tree", "string", "class", "loop", "the id of it"]) < 0.5).all()


def test_repeated_ids_give_one_row_of_the_fit(spark, tables):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)] + [(None, "x"), (5, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 3, int(i == 1)) for i in range(90)] + [(None, 1), (5, 1), (2, None)], "doc_id bigint, toxic int")
    rows, share = labelled_sample(docs, labels, "toxic", lambda i: i >= 0, "doc_id", "text", 3000, 100)
    assert sorted(rows) == [("text 0", 0), ("text 1", 1), ("text 101", 0)] or sorted(y for _, y in rows) == [0, 0, 1]
    assert len(rows) == 3 and share == 0.5  # ids 1 and 5 of four are toxic; the text of 5 is null


def test_held_out_labels_are_never_used(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = train(docs, labels), train(docs, flipped)
    assert a.landmarks == b.landmarks and (a.weights == b.weights).all() and (a.slope == b.slope).all() and a.shift == b.shift


def test_disguised_insults():
    clean = [f"the tree of thing{i} andre stood there{i % 7}" for i in range(300)]
    toxic = [f"the tree {w} thing{i}" for i, w in enumerate(["idiot", "moronic", "pathetic", "worthless"] * 30)]
    model = fit([(t, 0) for t in clean] + [(t, 1) for t in toxic])
    p = model.probability(Scorer(model).margins(["an idiot here", "i d i o t", "path-etic!", "worthxless", "id iot", "the tree", "", None]))
    assert (p[:5] > 0.5).all() and (p[5:] < 0.5).all()


def test_odd_rows(spark, tables, odd_docs, no_docs):
    docs, labels = tables
    model = train(docs, labels)
    rows = toxicity(odd_docs, labels, model=model).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    kept = drop_toxic(odd_docs, labels, model=model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["score"] < 0.5 for r in rows)
    assert toxicity(no_docs, labels, model=model).collect() == []
    none = toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and none[0]["score"] < 0.5
    one = labels.where("toxic = 0")
    assert toxicity(docs, one).where("predicted = 1").count() == 0
    nulls = labels.selectExpr("cast(null as bigint) as doc_id", "toxic").unionByName(labels.selectExpr("doc_id", "cast(null as int) as toxic"))
    assert toxicity(docs, nulls).count() == docs.count()
