import random
import re
from itertools import combinations

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicate_filter
from seglattice.llm.graph import components
from seglattice.llm.simhash import BITS, covering_masks, drop_near_duplicates, fingerprint, links, near_duplicates


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def unsigned(x):
    return x & (1 << 64) - 1


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text) == slow(text)


def test_every_close_pair_collides():
    masks = covering_masks()
    assert len(masks) == 7
    for i in range(BITS):
        for j in range(i, BITS):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    want = union({x for e in edges for x in e}, edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == set(want)
    assert len(set(zip(got.values(), (want[x] for x in got), strict=True))) == len(set(want.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_links_in_small_and_large_buckets(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(50)} | {0}
    for centre, n in ((rng.getrandbits(64), 400), (rng.getrandbits(64), 12)):
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(n)}
    x = rng.getrandbits(64)
    for _ in range(150):  # a chain
        x ^= 1 << rng.randrange(64) ^ 0 | 1 << rng.randrange(64)
        prints.add(x)
    want = union(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 2])
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = [(unsigned(r["a"]), unsigned(r["b"])) for r in links(spark.createDataFrame(signed, "fp bigint")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    assert union(prints, edges) == want


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {r["doc_id"]: slow(r["text"]) for r in docs.collect()}
    want = union(prints, [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert len(set(want.values())) < len(want)


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 14
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["fingerprint"] for i in (0, 1, 2)] == ["0" * 16] * 3 and by[2]["component_id"] == 0
    assert by[5]["component_id"] == 4
    assert near_duplicates(no_docs).collect() == [] and drop_near_duplicates(no_docs).collect() == []
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(False, 0)] + [(True, i) for i in (0, 3, 4, 6, 7, 8, 9, 10, 11)])


def test_one_row_of_each_group_whatever_its_id(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.Random(k).sample(words, 60)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (7, texts[5]), (8, texts[6]), (9, texts[7]), (9, texts[7]), (None, texts[7])]
    kept = [(r[0], r[1]) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5]), (8, texts[6]), (9, texts[7])]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def five_word_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def alike(a, b):
    return a == b or len(a & b) / len(a | b) >= 0.8


def test_stage_drops_all_similar_by_five_words(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 200)
    texts = ["", None, "one two", "one two", "one three"]
    for n in range(120):  # a large group: each shares 0.8 or more with the first, few with each other
        copy = list(base)
        for at in rng.sample(range(200), 1 + n % 4):
            copy[at] = f"x{n}.{at}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    for n in range(40):  # pairs around the bound
        own = rng.sample(words, 100)
        copy = list(own)
        for at in rng.sample(range(100), 1 + n % 5):
            copy[at] = f"y{n}.{at}"
        texts += [" ".join(own), " ".join(copy)]
    rng.shuffle(texts)
    sets, prints = [five_word_sets(t) for t in texts], [slow(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if alike(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2]
    want = sorted({d for d, root in union(range(len(texts)), near).items() if d == root})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near_duplicate_filter(spark, docs, "").collect()) == want


def test_no_similar_pair_of_documents_passes_the_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, prints = {d: five_word_sets(t) for d, t in texts.items()}, {d: slow(t) for d, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 2 or (0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a]) and alike(sets[a], sets[b]))]
    want = sorted({d for d, root in union(texts, near).items() if d == root})
    assert sorted(r["doc_id"] for r in near_duplicate_filter(spark, docs, "").collect()) == want
