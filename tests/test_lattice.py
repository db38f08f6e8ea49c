import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from seglattice.operators import lattice
from seglattice.operators.kernel import Kernel, compile_dictionary
from seglattice.operators.lattice import Categories, Surfaces, Texts
from seglattice.plans.latin import latin

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("theofanéß 12,.🍛東\x00\n"), max_size=30)), max_size=8)


def rows(array):
    return [[tuple(x.values()) for x in own] for own in array.to_pylist()]


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_characters_of_batches(texts):
    want = []
    for t in texts:
        at, own = 0, []
        for i, c in enumerate(t or ""):
            own.append((i, c, ord(c), at, at + len(c.encode())))
            at += len(c.encode())
        want.append(own)
    for batch in (pa.array(texts, pa.string()), pa.array(["éx", *texts, "y"], pa.string()).slice(1, len(texts))):
        assert rows(Texts(batch).characters()) == want


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_runs_and_surfaces_of_batches(texts):
    d = latin(user=True)
    batch = Texts(pa.array(texts, pa.string()))
    categories, kernel = Categories(d), Kernel(compile_dictionary(d))
    sets = categories.of(batch.codes)
    assert [categories.lists[s] for s in sets] == [d.categories_of(c) for c in batch.codes.tolist()]
    ends = categories.runs(batch, sets) - batch.start
    assert ends.tolist() == [e for t in texts for e in (kernel._runs(kernel.sets_of(Texts(pa.array([t], pa.string())).codes).tolist()) if t else [])]
    surfaces = lattice.surfaces_of(d.entries, d.user)
    at, length, number = Surfaces(surfaces).find(batch)
    got = sorted((int(batch.start[a]), int(a - batch.start[a]), surfaces[n]) for a, n in zip(at, number))
    want, base = [], 0
    for t in texts:
        want += [(base, i, w) for i in range(len(t or "")) for w in surfaces if t.startswith(w, i)]
        base += len(t or "")
    assert got == sorted(want) and all(len(surfaces[n]) == k for n, k in zip(number, length))


def test_surfaces_of_one_hash(monkeypatch):
    monkeypatch.setattr(Surfaces, "_ODD", Surfaces._ODD * 0)  # all hashes are equal
    at, length, number = Surfaces(["ab", "ba", "b"]).find(Texts(pa.array(["aba"])))
    assert sorted(zip(at.tolist(), number.tolist())) == [(0, 0), (1, 1), (1, 2)]
    assert Surfaces([]).find(Texts(pa.array(["x"])))[0].size == 0 and Surfaces([""]).find(Texts(pa.array([], pa.string())))[0].size == 0


@pytest.fixture(scope="module")
def repeated(spark):
    data = [(1, "ab"), (1, "éß"), (None, "the of"), (None, None), (2, ""), (1, "ab")]
    return spark.createDataFrame(data, "id bigint, t string").coalesce(1)


def test_repeated_and_null_keys_mix_nothing(spark, repeated):
    got = sorted(tuple(r)[1:] for r in lattice.characters(repeated, "id", "t").where("id = 1").collect())
    ab, rest = [(0, "a", 97, 0, 1), (1, "b", 98, 1, 2)], [(0, "é", 233, 0, 2), (1, "ß", 223, 2, 4)]
    assert got == sorted(ab + rest + ab)
    assert sorted(map(tuple, lattice.text_sizes(repeated, "id", "t").collect()), key=repr) == sorted([(1, 2, 2), (1, 2, 4), (None, 6, 6), (None, None, None), (2, 0, 0), (1, 2, 2)], key=repr)
    lengths = lattice.run_lengths(repeated, "id", "t", latin()).collect()
    assert sorted(map(tuple, lengths), key=repr) == sorted([(1, 2, 3, 2), (1, 2, 3, 2), (1, 2, 3, 2), (None, 6, 10, 3), (None, None, None, None), (2, 0, 0, 0)], key=repr)
    found = lattice.known_edges(repeated, "id", "t", latin())
    assert {(r["start"], r["end"], r["surface"]) for r in found.where("id IS NULL").collect()} >= {(0, 2, "th"), (0, 3, "the"), (4, 6, "of")}
    assert found.where("id = 1 AND surface = 'a'").count() == 2


def test_no_character_is_shuffled(spark, repeated):
    plan = lattice.with_runs(repeated, "id", "t", latin())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_long_texts(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "of", "zé", "12"]) for _ in range(200_000))
    df = spark.createDataFrame([(1, text)], "id bigint, t string")
    r = lattice.run_lengths(df, "id", "t", latin()).first()
    assert r["chars"] == len(text) and r["longest"] == 3
    assert lattice.surface_counts(df, "id", "t", ["the"]).collect()[0]["n"] == text.count("the")
