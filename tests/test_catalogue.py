import hashlib
import json
from collections import Counter

import pytest

import __spark_entry__
from seglattice.operators.kernel import Kernel, compile_dictionary
from seglattice.plans import catalogue
from seglattice.plans.latin import latin

from . import naive
from .compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) is None


def test_ignore_space_equals_brute_force(spark):
    texts = {r["id"]: r["t"] for r in catalogue.items(spark, SF).collect()}
    got = {}
    for r in catalogue.q_tokens_ignore_space(spark, SF).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["s"], r["e"], r["wid"], r["total"]))
    assert got == {i: found for i, t in texts.items() if (found := naive.tokenize(latin(), t, ignore_space=True))}


def test_documents_equal_brute_force(spark):
    texts = {r["id"]: r["t"] for r in catalogue.documents(spark, SF).collect()}
    counts = {r["id"]: r["n"] for r in catalogue.q_count_documents(spark, SF).collect()}
    short = [i for i, t in texts.items() if len(t) < 600]
    assert set(counts) == set(texts) and len(short) > 20
    for i in short:
        assert counts[i] == len(naive.tokenize(latin(), texts[i]))
    kernel = Kernel(compile_dictionary(latin()))
    assert {i: kernel.count(t) for i, t in texts.items()} == counts
    frequency = catalogue.q_token_freq(spark, SF).collect()
    plain, docs = Counter(), Counter()
    for t in texts.values():
        found = Counter((t[a:b], w >= 1 << 31) for a, b, w, _ in kernel.tokenize(t))
        plain.update(found)
        docs.update(found.keys())
    assert {(r["surface"], r["is_unknown"]): (r["n"], r["docs"]) for r in frequency} == {k: (n, docs[k]) for k, n in plain.items()}
    lines = {r["id"]: r["words"] for r in catalogue.q_line_counts(spark, SF).collect()}
    assert lines == {i: sum(kernel.count(x) for x in t.split("\n")) for i, t in texts.items()}


def test_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
    assert catalogue.q_page_words(spark, SF).where("words > 0").count() > 0
    assert catalogue.q_windowed_counts(spark, SF).count() > 0


def test_document_queries_equal_brute_force(spark):
    texts = {r["id"]: r["t"] for r in catalogue.documents(spark, SF).collect()}
    short = {i for i, t in texts.items() if t is not None and len(t) < 600}
    spaced = {r["id"]: (r["words"], r["digest"]) for r in catalogue.q_document_ignore_space(spark, SF).collect()}
    jsons = {r["id"]: (r["bytes"], r["digest"]) for r in catalogue.q_document_json(spark, SF).collect()}
    assert set(spaced) == set(jsons) == set(texts)
    d = latin()
    for i in short:
        t = texts[i]
        place = lambda n: len(t[:n].encode())  # noqa: B023, E731
        found = naive.tokenize(d, t, ignore_space=True)
        said = ",".join(f"{place(s)}-{place(e)}-{w}" for s, e, w, _ in found)
        assert spaced[i] == (len(found), hashlib.md5(said.encode()).hexdigest())
        objects = [
            {"surface": t[s:e], "feature": d.feature(w), "start": place(s), "end": place(e), "startChar": s, "endChar": e, "wordId": w, "totalCost": c, "unknown": w >= 1 << 31}
            for s, e, w, c in naive.tokenize(d, t)
        ]
        said = json.dumps(objects, ensure_ascii=False, separators=(",", ":")).encode()
        assert jsons[i] == (len(said), hashlib.md5(said).hexdigest())
