import hashlib
import random
import re

from seglattice.llm.decontam import contamination_report, drop_contaminated, words_of
from seglattice.llm.queries import ORACLE_SQL, QUERIES

from ..compare import compare

DOCS = "/root/testdata/sf0.001"


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, hit, found = slow_words(text), set(), set()
        at = {}
        for i in range(len(words)):
            at.setdefault(words[i], []).append(i)
        for item, own in items:
            w = slow_words(own)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                part = w[k : k + window]
                for i in at.get(part[0], []):
                    if words[i : i + len(part)] == part:
                        hit.update(range(i, i + len(part)))
                        found.add("" if item is None else str(item))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def pairs(df, a, b):
    return [(r[a], r[b]) for r in df.collect()]


def test_words():
    for text in (None, "", "Don't STOP-me 123abc Ünïcode 🍛x\x00y\x7fz_a", "É é ẞ"):
        assert [w.decode() for w in words_of(text)] == slow_words(text)


def test_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DOCS}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs, "doc_id", "text"), pairs(bench, "item_id", "text"))
    assert sum(r[5] for r in want) > 0
    assert sorted((tuple(r) for r in contamination_report(docs, bench).collect()), key=str) == want
    small = contamination_report(docs, bench, block_bytes=2500)  # several blocks, and an exact union of them
    assert sorted((tuple(r) for r in small.collect()), key=str) == want


def test_random_small_vocabulary(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") + rng.choice(["", "!", "'"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(25)] + [(3, text(4)), (None, "a b c a b c"), (99, None)]
    docs = [(i, text(rng.choice([0, 1, 2, 8, 12, 60]))) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    for blocks in (1 << 20, 150):
        assert sorted((tuple(r) for r in contamination_report(d, b, block_bytes=blocks).collect()), key=str) == want


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "same text here"), (2, None), (3, "")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contamination_report(odd_docs, b).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute(pairs(odd_docs, "doc_id", "text"), items)
    kept = drop_contaminated(odd_docs, b)
    assert kept.columns == odd_docs.columns and kept.count() == 12
    assert contamination_report(no_docs, b).collect() == []
    assert drop_contaminated(odd_docs, b.limit(0)).count() == 14


def test_long_text(spark):
    words = [f"w{i % 977}" for i in range(700_000)]
    words[650_000:650_012] = [f"leak{i}" for i in range(12)]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, " ".join(f"leak{i}" for i in range(12)))], "item_id bigint, text string")
    row = contamination_report(d, b).first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (700_000, 12, 1)


def test_rows_equal_sql(spark):
    name = "op10_prefix_filtered_leaks"
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], DOCS) is None
