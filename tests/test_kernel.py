import random
from pathlib import Path

import pytest

from seglattice.operators.kernel import Kernel, compile_dictionary
from seglattice.operators.tokenizer import byte_offsets
from seglattice.plans.latin import latin
from seglattice.schema import UNKNOWN_BASE, DictionaryError
from seglattice.sources.dictionary import Dictionary

from . import naive

HERE = Path(__file__).parent / "resources"


def quad(name):
    return Dictionary.from_mecab_text(*((HERE / name / f).read_text(encoding="utf-8") for f in ("lex.csv", "matrix.def", "char.def", "unk.def")))


MINIMAL = Dictionary.from_minimal((HERE / "minimal.dict").read_text(encoding="utf-8"))
SMALL, COMPAT = quad("small"), quad("compat")
USER = COMPAT.with_user_lexicon((HERE / "compat/user.csv").read_text(encoding="utf-8"))


def words(d, text, **options):
    kernel = Kernel(compile_dictionary(d, **options))
    found = kernel.tokenize(text)
    place = byte_offsets(text)
    at = (lambda i: i) if place is None else (lambda i: int(place[i]))
    assert kernel.count(text) == len(found)
    assert found == naive.tokenize(d, text, **options)
    return [(text[a:b], at(a), at(b), a, b, w, kernel.feature(w), c) for a, b, w, c in found]


def surfaces(d, text, **options):
    return [w[0] for w in words(d, text, **options)]


# Fixed values, down to test_grouping_limit: golden segmentations, costs and features of the dictionaries in resources.


def test_compound_words():
    got = words(MINIMAL, "本とカレー")
    assert [(w[0], w[1], w[2], w[7]) for w in got] == [("本と", 0, 6, 1), ("カレー", 6, 15, 11)]
    assert got[0][6] == "compound,book-and" and [w[5] for w in words(SMALL, "本とカレー")] == [3, 2]


def test_unknown_characters():
    got = words(MINIMAL, "本X🍛")
    assert [(w[0], w[1], w[2], w[5] >= UNKNOWN_BASE) for w in got] == [("本", 0, 3, False), ("X", 3, 4, True), ("🍛", 4, 8, True)]
    assert got[1][6] == "UNK" and surfaces(MINIMAL, "本\0カレー") == ["本", "\0", "カレー"]
    assert surfaces(SMALL, "本X🍛カレー") == ["本", "X🍛カレー"]


def test_costs():
    assert [(w[0], w[7]) for w in words(COMPAT, "東京都")] == [("東京都", 5241)]
    assert [(w[0], w[7]) for w in words(COMPAT, "京都東京都京都")] == [("京都", 5214), ("東京都", 11103), ("京都", 16044)]
    assert [(w[0], w[7]) for w in words(USER, "京都東京都京都")] == [("京都東京都", -1079), ("京都", 3862)]
    assert [(w[0], w[6], w[7]) for w in words(COMPAT, "kampersanda")] == [("kampersanda", "名詞,普通名詞,一般,*,*,*", 12520)]
    assert [w[7] for w in words(USER, "kampersanda")] == [-1113]
    assert [(w[0], w[6], w[7]) for w in words(COMPAT, "一橋大学大学院")] == [("一橋大学大学院", "名詞,数,*,*,*,*,*", 28360)]
    assert [len(words(COMPAT, t)) for t in ("東京県に行く", "東京に行く", "", "kampersanda")] == [4, 3, 0, 1]


def test_spaces():
    assert surfaces(COMPAT, "東京 都") == ["東京", " ", "都"]
    spans = lambda t: [(w[0], w[1], w[2]) for w in words(COMPAT, t, ignore_space=True)]
    assert spans("東京 都") == [("東京", 0, 6), ("都", 7, 10)] and spans("東京   都") == [("東京", 0, 6), ("都", 9, 12)]
    assert spans("   東京都") == [("東京都", 3, 12)] and spans("東京都   ") == [("東京都", 0, 9)] and spans("   ") == []
    with pytest.raises(DictionaryError):
        compile_dictionary(MINIMAL, ignore_space=True)


def test_grouping_limit():
    got = words(COMPAT, "kampersanda", ignore_space=True, max_grouping=9)
    assert [(w[0], w[7]) for w in got] == [("k", 12520), ("ampersanda", 26494)]
    d = Dictionary.from_mecab_text("本,0,0,10,noun\n", "1 1\n0 0 0\n", "DEFAULT 0 1 0\nALPHA 1 1 0\n0x0041..0x005A ALPHA\n", "DEFAULT,0,0,100,*\nALPHA,0,0,5,alpha\n")
    assert surfaces(d, "ABC", max_grouping=2) == ["ABC"] and surfaces(d, "本ABC") == ["本", "ABC"] and surfaces(d, "ABCD", max_grouping=2) != ["ABCD"]


def test_33_words():
    d = Dictionary.from_minimal("matrix\t1\t1\n0\n" + "".join(f"entry\t語{i}\t0\t0\t1\tfeature-{i}\n" for i in range(33)))
    assert [(w[0], w[6]) for w in words(d, "語32")] == [("語32", "feature-32")]


CHAR = "DEFAULT 0 1 0\nSPACE 0 1 0\nALPHA 1 1 2\nKANA 1 0 2\nNUM 1 1 0\nEMPTY 1 1 1\n0x0020 SPACE\n0x0061..0x0066 ALPHA\n0x0063 KANA ALPHA\n0x0064 NUM KANA\n0x3042..0x3050 KANA\n0x0030..0x0039 NUM\n0x007A EMPTY\n0x1F300..0x1FAFF EMPTY NUM\n"


def random_dictionary(rng):
    size = rng.randrange(1, 4)
    pool = "abcdあい0 z🍛本"
    word = lambda: "".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))
    row = lambda s: f"{s},{rng.randrange(size)},{rng.randrange(size)},{rng.randrange(-3, 6)},f{rng.randrange(9)}\n"
    lex = "".join(row(word()) for _ in range(rng.randrange(1, 25)))
    matrix = f"{size} {size}\n" + "".join(f"{r} {left} {rng.randrange(-2, 3)}\n" for r in range(size) for left in range(size))
    unk = "".join(row(rng.choice(["DEFAULT", "SPACE", "ALPHA", "KANA", "NUM"])) for _ in range(rng.randrange(0, 8)))
    d = Dictionary.from_mecab_text(lex, matrix, CHAR, unk)
    return d.with_user_lexicon("".join(row(word()) for _ in range(2))) if rng.random() < 0.4 else d


def test_random_dictionaries_and_texts():
    """Small costs and many homographs: ties everywhere."""
    rng = random.Random(11)
    for _ in range(250):
        d = random_dictionary(rng)
        for options in ({}, {"ignore_space": True}, {"max_grouping": 2}, {"ignore_space": True, "max_grouping": 1}):
            kernel = Kernel(compile_dictionary(d, **options))
            for _ in range(8):
                text = "".join(rng.choice("abcdefあい01  z🍛本\n") for _ in range(rng.randrange(0, 30)))
                want = naive.tokenize(d, text, **options)
                assert kernel.tokenize(text) == want and kernel.tokenize(text) == want, (text, options)
                assert kernel.count(text) == len(want)


def xorshift(seed, salt):
    x = (seed * 0x9E3779B97F4A7C15 ^ salt) & (1 << 64) - 1 or 1
    while True:
        x ^= x << 13 & (1 << 64) - 1
        x ^= x >> 7
        x ^= x << 17 & (1 << 64) - 1
        yield x


def test_512_seeds_cover_the_text():
    pool = "東京都に行く本とカレーアイ一二0123abcX \n、。🍛"
    kernels = [Kernel(compile_dictionary(d)) for d in (MINIMAL, COMPAT)]
    for seed in range(512):
        draw = xorshift(seed, 0xA5A55A5ADEADBEEF)
        text = "".join(pool[next(draw) % len(pool)] for _ in range(next(draw) % 96))
        for kernel in kernels:
            found = kernel.tokenize(text)
            assert "".join(text[a:b] for a, b, _, _ in found) == text
            assert [a for a, _, _, _ in found[1:]] == [b for _, b, _, _ in found[:-1]]


def test_long_runs():
    text = "x" * 3000 + " " + "東" * 500
    assert surfaces(COMPAT, text[:400])
    kernel = Kernel(compile_dictionary(COMPAT))
    assert "".join(text[a:b] for a, b, _, _ in kernel.tokenize(text)) == text


@pytest.mark.parametrize("limit", ["MEMO_PIECES", "MEMO_FRONTS"])
def test_a_full_memory_starts_again(monkeypatch, limit):
    monkeypatch.setattr(f"seglattice.operators.kernel.{limit}", 5)
    kernel = Kernel(compile_dictionary(COMPAT))
    for i in range(60):
        text = f"東京{i} 京都{i % 7}に"
        assert kernel.tokenize(text) == naive.tokenize(COMPAT, text)
        assert kernel.count(text) == len(kernel.tokenize(text))


def test_memory_is_bounded_inside_a_text(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("theofaé1.") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    plain = Kernel(compile_dictionary(latin()))
    want = plain.tokenize(text), plain.count(text)
    monkeypatch.setattr("seglattice.operators.kernel.MEMO_PIECES", 40)
    monkeypatch.setattr("seglattice.operators.kernel.MEMO_FRONTS", 25)
    small = Kernel(compile_dictionary(latin()))
    assert (small.tokenize(text), small.count(text)) == want
    assert len(small.memo) <= 41 and len(small.older) <= 41 and len(small.front_list) <= 26
