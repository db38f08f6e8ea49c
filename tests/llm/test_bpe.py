import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seglattice.llm.bpe import LONG_WORD, Encoder, Lexicon, Vocabulary, decode_udf, encode_udf, encoder_factory, frequent_words, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"
POOL = "aAbBéÉßİıſ'sStT 09²½ \t\n\x0b\x0c\x1f\x85\xa0́ͅΩςσ한<|>endoftx!?#$%_-—…​ 🍛👍🏽ﬁǅȺ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(Path(PATH).read_text(encoding="utf-8"))


def same(encoder, library, texts):
    ids, ends = encoder.encode(texts)
    for text, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.tolist() == want, text
        assert encoder.decode(own).decode() == library.decode(want, skip_special_tokens=False)


def test_encoder_equals_the_library(library, vocabulary, tmp_path):
    rng = random.Random(1)
    words = ["the", "thing", "tree", "trees", "é", "x" * 60, "zzz"]
    path = str(tmp_path / "lex")
    Lexicon.compile({w: list(map(int, vocabulary.merge(w))) for w in words}, path)
    texts = ["", "Don't I'LL we've 's!'s", "x" * 5000, "aA" * 400, "<|endoftext|> hi <|startoftext|><|endoftext|>x <|ENDOFTEXT|>", "trees tree the thing thingy zzz é"]
    texts += ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    for lexicon in (None, Lexicon(path)):
        same(Encoder(vocabulary, lexicon), library, texts)
        small = Encoder(vocabulary, lexicon, memo_words=20)  # generations come and go
        for i in range(0, len(texts), 50):
            same(small, library, texts[i : i + 50])


def test_merges_agree_at_every_length(library, vocabulary):
    rng = random.Random(2)
    for n in [*range(1, 70), LONG_WORD, LONG_WORD + 1, 300]:
        word = "".join(rng.choice("thereandingo") for _ in range(n))
        assert list(vocabulary.merge(word)) == library.encode(word, add_special_tokens=False).ids
        assert vocabulary._merge_long(vocabulary._bytes(word.encode())) == list(vocabulary.merge(word))


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(3)
    entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) + rng.choice(["ing", "ed", "ü", ""]): [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for _ in range(900)}
    size = Lexicon.compile(entries, str(tmp_path / "a"))
    Lexicon.compile(dict(reversed(list(entries.items()))), str(tmp_path / "b"))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    # minimal: as many states as there are different sets of endings
    prefixes = {w.encode()[:i] for w in entries for i in range(len(w.encode()) + 1)}
    endings = {p: frozenset(w.encode()[len(p) :] for w in entries if w.encode().startswith(p)) for p in prefixes}
    assert size["states"] == len(set(endings.values()))
    lexicon = Lexicon(str(tmp_path / "a"))
    words = list(entries) + [w + "q" for w in entries] + [w[:-1] for w in entries] + ["", "zzzz"]
    for word, place in zip(words, lexicon.find(words).tolist(), strict=True):
        assert (place >= 0) == (word in entries)
        if place >= 0:
            assert lexicon.ids[lexicon.start[place] : lexicon.start[place + 1]].tolist() == entries[word]
    assert sorted(lexicon.find(list(entries)).tolist()) == list(range(len(entries)))
    Lexicon.compile({}, str(tmp_path / "c"))
    assert Lexicon(str(tmp_path / "c")).find(["a"]).tolist() == [-1]
    (tmp_path / "d").write_bytes(b"x" * 80)
    with pytest.raises(ValueError):
        Lexicon(str(tmp_path / "d"))


def test_frequent_words_count_every_row(spark):
    df = spark.createDataFrame([("b B a",), ("a c-c c",), (None,), ("",)], "text string")
    assert frequent_words(df, limit=2) == ["c", "a"]


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents(spark, library, odd_docs, no_docs):
    for docs in (spark.read.parquet(DOCS), odd_docs):
        want = sorted((str(r["doc_id"]), *digests(library, r["text"])) for r in docs.collect())
        assert sorted((str(r[0]), *r[1:]) for r in token_digests(docs, PATH, lexicon_words=300).collect()) == want
    assert token_digests(no_docs, PATH).collect() == []


def test_columns(spark, library, odd_docs):
    make = encoder_factory(spark, PATH, ["same", "text"])
    rows = odd_docs.withColumn("ids", encode_udf(make)("text")).withColumn("back", decode_udf(make)("ids")).select("text", "ids", "back").collect()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == library.decode(ids, skip_special_tokens=False)
    assert spark.range(1).select(decode_udf(make)(F.lit(None).cast("array<int>"))).first()[0] is None
