import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from seglattice.llm.token_output import WaveletMatrix, read_tokens, token_output, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(0, 70_000))
@settings(max_examples=120, deadline=None)
def test_wavelet_matrix(ids, other):
    array = np.array(ids, np.int32)
    blob = WaveletMatrix.pack(array)
    assert WaveletMatrix.decode(blob).tolist() == ids
    w = WaveletMatrix.from_bytes(blob)
    assert w.access(np.arange(len(ids))).tolist() == ids
    for token in [*ids[:5], other]:
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            where = [i for i in range(a, b) if ids[i] == token]
            assert w.count(token, a, b) == len(where) and w.locate(token, a, b).tolist() == where


def test_long_sequence():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.2, 100_003) % 49408).astype(np.int32)
    w = WaveletMatrix.of(ids)
    at = rng.integers(0, len(ids), 500)
    assert (w.access(at) == ids[at]).all() and (WaveletMatrix.decode(WaveletMatrix.pack(ids)) == ids).all()
    for token in (1, 2, 49407):
        assert (w.locate(token, 64, 99_999) == np.flatnonzero(ids[64:99_999] == token) + 64).all()
    with pytest.raises(IndexError):
        w.access(len(ids))
    blob = WaveletMatrix.pack(ids)
    for bad in (b"x" * 40, blob[:-1], blob + b"x"):
        with pytest.raises(Exception):
            WaveletMatrix.decode(bad)


def expected(docs):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 5000, "segment_tokens": 3000}])
def test_documents(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(tuple(r) for r in token_output(docs.repartition(5), PATH, **options).collect())
    assert got == want


def test_files_hold_everything(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "tree", "zq"]) for _ in range(rng.randrange(30)))) for i in range(100)]
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, path, shard_bytes=500, segment_tokens=100)
    library = Tokenizer.from_file(PATH)
    want = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 2]]
    stored = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["shard"], r["segment"]))
    assert len(stored) > 20 and [d for r in stored for d in r["doc_ids"]] == list(range(100))
    matrices = [WaveletMatrix.from_bytes(bytes(r["wavelet"])) for r in stored]
    assert [i for m in matrices for i in m.access(np.arange(m.n)).tolist()] == want
    the = library.encode("the", add_special_tokens=False).ids[0]
    assert sum(m.count(the) for m in matrices) == want.count(the)
    assert read_tokens(spark, path).count() == 100


def test_a_hot_id_is_spread_over_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seglattice.llm.token_output.GROUP", 3)
    rows = [(None if i % 2 else 7, "the tree" if i % 4 else f"the tree {i}") for i in range(400)] + [(i, "the") for i in range(20)]
    docs, path = spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/tokens"
    write_tokens(docs, PATH, path, shard_bytes=300)
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(shards) > 15 and max(r["n"] for r in shards) < 120
    got = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0


def test_odd_rows(spark, odd_docs, no_docs):
    got = token_output(odd_docs, PATH).collect()
    want = expected([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [w[0] for w in want]
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted(r["start"] for r in got)[-1] < sum(w[2] for w in want)
    assert token_output(no_docs, PATH).collect() == []
