import gzip
import hashlib
import struct
from dataclasses import replace
from pathlib import Path

import pytest

from seglattice.operators.kernel import Kernel, compile_dictionary
from seglattice.schema import OUTSIDE_COST, DictionaryError
from seglattice.sources.binary import VERSION_2, read_dictionary, write_dictionary
from seglattice.sources.dictionary import Dictionary, invalid_ids, lines, parse_range, prepare_bundle

from .test_kernel import COMPAT, HERE, MINIMAL, SMALL, USER, quad

LEX, MATRIX, CHAR, UNK = "a,0,0,1,f\n", "1 1\n0 0 0\n", "DEFAULT 0 1 0\n", "DEFAULT,0,0,1,*\n"


def same(a, b):
    return replace(a, matrix=None) == replace(b, matrix=None) and a.matrix.right_size == b.matrix.right_size and a.matrix.left_size == b.matrix.left_size and a.matrix.costs.tolist() == b.matrix.costs.tolist()


def test_fixtures():
    assert (len(MINIMAL.entries), len(COMPAT.entries), len(COMPAT.unknown), len(USER.user)) == (5, 46, 4, 3)
    assert COMPAT.entries[39].surface == " " and COMPAT.entries[3].feature.endswith("1/5")
    assert COMPAT.matrix.cost(1, 0) == -3689 and COMPAT.matrix.cost(0, 1) == 863 and COMPAT.matrix.cost(10, 0) == OUTSIDE_COST
    assert COMPAT.categories_of(0x4E00) == (8, 2) and COMPAT.categories_of(0x4E01) == (2,) and COMPAT.categories_of(0x1F600) == (0,)
    assert len(Dictionary.builtin().entries) == 3


def test_csv_rows():
    d = Dictionary.from_mecab_text('"a,b",0,0,1,"x ""y""",z\n,0,0,1,skipped\nc,0,0,2,w\r\n', MATRIX, CHAR, UNK)
    assert [(e.surface, e.feature) for e in d.entries] == [("a,b", 'x "y",z'), ("c", "w")]


def test_matrix_of_other_shape_and_orientation():
    d = Dictionary.from_minimal("matrix\t2\t3\n1\t2\t3\n4\t5\t6\nentry\ta\t9\t9\t1\tf\n")
    assert [d.matrix.cost(r, left) for left in range(3) for r in range(2)] == [1, 2, 3, 4, 5, 6]
    m = Dictionary.from_mecab_text(LEX, "2 3\n1 2 7\n1 2 8\n\n0 0 -1\n", CHAR, UNK).matrix
    assert (m.cost(1, 2), m.cost(0, 0), m.cost(1, 1)) == (8, -1, 0)
    # ids outside the matrix are allowed here, at a price
    assert Kernel(compile_dictionary(d)).tokenize("a")[0][3] == OUTSIDE_COST + 1


def test_ranges():
    assert parse_range("0x0041..0x005A") == (0x41, 0x5B) and parse_range("0x20") == (0x20, 0x21)
    for bad in ("0x41..0x40", "0x1..0x2..0x3", "0xZZ", "0x", "0x-1"):
        with pytest.raises(DictionaryError):
            parse_range(bad)
    d = Dictionary.from_mecab_text(LEX, MATRIX, CHAR + "A 1 1 1\n# c\n0x41..0x50 A # B\n0x1F600 A\n0x45 DEFAULT A\n", UNK)
    assert d.categories_of(0x41) == (1,) and d.categories_of(0x45) == (0, 1) and d.categories_of(0x1F600) == (1,)
    assert d.categories_of(0x51) == (0,)


@pytest.mark.parametrize(
    "texts",
    [
        ("a,0,0,1\n", MATRIX, CHAR, UNK), ("a,x,0,1,f\n", MATRIX, CHAR, UNK), ("a,0,70000,1,f\n", MATRIX, CHAR, UNK), ("a,0,0,1.5,f\n", MATRIX, CHAR, UNK), ("a,1,0,1,f\n", MATRIX, CHAR, UNK), ("a,0,1,1,f\n", MATRIX, CHAR, UNK),
        (LEX, "", CHAR, UNK), (LEX, "1\n", CHAR, UNK), (LEX, "1 x\n", CHAR, UNK), (LEX, "1 1\n0 0\n", CHAR, UNK), (LEX, "1 1\n1 0 0\n", CHAR, UNK), (LEX, "1 1\n0 0 40000\n", CHAR, UNK),
        (LEX, MATRIX, "SPACE 0 1 0\n", UNK), (LEX, MATRIX, "DEFAULT 2 1 0\n", UNK), (LEX, MATRIX, "DEFAULT 0 1\n", UNK), (LEX, MATRIX, CHAR + "0x20\n", UNK), (LEX, MATRIX, CHAR + "0x20 NONE\n", UNK), (LEX, MATRIX, CHAR + "0x20 # c\n", UNK), (LEX, MATRIX, "DEFAULT 0 1 x\n", UNK),
        (LEX, MATRIX, CHAR, "OTHER,0,0,1,*\n"), (LEX, MATRIX, CHAR, "DEFAULT,0,5,1,*\n"),
    ],
)
def test_malformed_texts(texts):
    with pytest.raises(DictionaryError):
        Dictionary.from_mecab_text(*texts)


@pytest.mark.parametrize("text", ["", "matrix\t1\t1\n0\n", "entry\ta\t0\t0\t1\tf\n", "matrix\t1\t1\nentry\ta\t0\t0\t1\tf\n", "matrix\t1\t1\n0\t0\nentry\ta\t0\t0\t1\tf\n", "matrix\t1\t1\n0\nentry\ta\t0\t0\t1\n", "what\n", "matrix\t1\t1\nx\nentry\ta\t0\t0\t1\tf\n"])
def test_malformed_minimal(text):
    with pytest.raises(DictionaryError):
        Dictionary.from_minimal(text)


def test_user_lexicon_replaces_and_clears():
    d = SMALL.with_user_lexicon("x,0,0,1,f\n").with_user_lexicon("y,0,0,1,f\n")
    assert [e.surface for e in d.user] == ["y"] and d.with_user_lexicon(None).user == () and d.feature(1 << 30) == "f"
    with pytest.raises(DictionaryError):
        SMALL.with_user_lexicon("x,1,0,1,f\n")


def test_horizontal_bar():
    args = (LEX, "6 6\n", CHAR, UNK)
    assert len(Dictionary.from_mecab_text(*args).entries) == 1
    assert Dictionary.from_mecab_text(*args, horizontal_bar=True).entries[1].surface == "―"
    with pytest.raises(DictionaryError):
        Dictionary.from_mecab_text(LEX, MATRIX, CHAR, UNK, horizontal_bar=True)


def test_binary_round_trip():
    for d in (COMPAT, SMALL, MINIMAL, Dictionary.builtin()):
        data = write_dictionary(d)
        assert same(read_dictionary(data), d)
        assert same(read_dictionary(VERSION_2 + data[8:] + struct.pack("<10I", *[0] * 10)), d)
        for bad in (b"", b"DLRDIC09" + data[8:], data[:-1], data + b"x", data[:40]):
            with pytest.raises(DictionaryError):
                read_dictionary(bad)
    assert Kernel(compile_dictionary(read_dictionary(write_dictionary(COMPAT)))).tokenize("東京都")[0][3] == 5241


def test_folders_and_tables(spark, tmp_path):
    assert same(Dictionary.from_mecab(spark, f"file://{HERE}/compat"), COMPAT)
    for name in ("lex.csv", "matrix.def", "char.def", "unk.def"):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress((HERE / "compat" / name).read_bytes()))
    assert same(Dictionary.from_mecab(spark, f"file://{tmp_path}", **{k: f"{v}.gz" for k, v in {"lex": "lex.csv", "matrix": "matrix.def", "char": "char.def", "unk": "unk.def"}.items()}), COMPAT)
    USER.save(spark, f"file://{tmp_path}/store")
    assert same(Dictionary.load(spark, f"file://{tmp_path}/store"), USER)
    tables = COMPAT.tables(spark)
    assert invalid_ids(tables["lexicon"], tables["connection"]).isEmpty()
    assert invalid_ids(tables["lexicon"], tables["connection"].where("right_id < 9")).count() == 21


def test_several_lexicon_files_in_another_encoding(spark, tmp_path):
    for name, text in (("b.csv", "東京,0,0,2,b\n"), ("a.csv", "本,0,0,1,a\n\n")):
        (tmp_path / name).write_bytes(text.encode("euc_jp"))
    for name in ("matrix.def", "char.def", "unk.def"):
        (tmp_path / name).write_bytes((HERE / "small" / name).read_bytes())
    d = Dictionary.from_mecab(spark, f"file://{tmp_path}", lex="*.csv", encoding="euc_jp")
    assert [e.surface for e in d.entries] == ["本", "東京"]


def test_lines():
    assert lines("a\r\n\nb\x0bc\n") == ["a", "", "b\x0bc"] and lines("") == [] and lines("a") == ["a"]
    assert Path(HERE, "minimal.dict").exists() and quad("small").matrix.right_size == 1


def test_bundles_are_the_same_each_time(spark, tmp_path):
    files = {"b.csv": "と,0,0,1,助詞".encode("EUC-JP"), "a.csv": "本,0,0,10,名詞\n".encode("EUC-JP"), "matrix.def": b"1 1\n0 0 0\n", "char.def": b"DEFAULT 1 0 1\n", "unk.def": b"DEFAULT,0,0,9,*\n", "README": b"x"}
    made = prepare_bundle(files)
    assert made == prepare_bundle(dict(reversed(files.items()))) and set(made) == {"lex.csv.gz", "matrix.def.gz", "char.def.gz", "unk.def.gz", "SHA256SUMS"}
    assert gzip.decompress(made["lex.csv.gz"]).decode() == "本,0,0,10,名詞\nと,0,0,1,助詞\n"
    sums = dict(reversed(line.split("  ")) for line in made["SHA256SUMS"].decode().splitlines())
    assert sums == {n.removesuffix(".gz"): hashlib.sha256(gzip.decompress(d)).hexdigest() for n, d in made.items() if n.endswith(".gz")}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    d = Dictionary.from_mecab(spark, f"file://{tmp_path}", lex="lex.csv.gz", matrix="matrix.def.gz", char="char.def.gz", unk="unk.def.gz")
    assert [e.surface for e in d.entries] == ["本", "と"]
    with pytest.raises(DictionaryError):
        prepare_bundle({"matrix.def": b""})


def test_binary_files_by_path(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(write_dictionary(COMPAT))
    assert same(Dictionary.from_binary(spark, f"file://{tmp_path}/d.bin"), COMPAT)
    (tmp_path / "e.bin").write_bytes(b"x")
    with pytest.raises(DictionaryError):
        Dictionary.from_binary(spark, f"file://{tmp_path}/*.bin")
