from functools import cache
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from seglattice.llm import quality, toxicity

from .test_bpe import digests
from .test_decontam import brute
from .test_simhash import alike, five_word_sets, slow, union

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tox, good = toxicity.train(docs, labels), quality.train(docs, labels)
    primal = tox.primal()
    margin = cache(lambda token: round(max(tox.margins(toxicity.unit_pieces(token), primal).tolist(), default=tox.bias), 4))

    def tops(text):
        own = {margin(t) for t in toxicity.tokens(text or "", tox.parts)}
        return (sorted(own, reverse=True) + [toxicity.HELD[0]] * toxicity.TOP)[: toxicity.TOP]

    clean = [d for d, t in texts.items() if tox.probability(np.array([tops(t)]))[0] < 0.5]
    fine = [d for d in clean if good.scores([texts[d]])[0] >= 0.5]
    prints = {d: slow(texts[d]) for d in fine}
    sets = {d: five_word_sets(texts[d]) for d in fine}
    near = [(a, b) for a, b in combinations(sorted(fine), 2) if (prints[a] ^ prints[b]).bit_count() <= 2 or (0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a]) and alike(sets[a], sets[b]))]
    own = {d for d, root in union(prints, near).items() if d == root}
    leaks = {r[0] for r in brute([(d, texts[d]) for d in own], [(r["item_id"], r["text"]) for r in bench.collect()]) if r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d, *digests(library, texts[d])) for d in own - leaks)
    assert len(texts) > len(clean) > len(fine) > len(own) > len(own - leaks)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_columns_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels, "doc_id")
    for stage, sound, column in ((corpus_pipeline.toxicity_filter, 0, "toxic"), (corpus_pipeline.quality_filter, 1, "quality")):
        clean = labelled.where(f"{column} = {sound}").select(docs.columns)
        assert stage(spark, clean, SF).count() >= 0.98 * clean.count()
        bad = labelled.where(f"{column} <> {sound}").select(docs.columns)
        assert stage(spark, bad, SF).count() <= 0.2 * bad.count()
