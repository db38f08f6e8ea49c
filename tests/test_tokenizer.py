import json

import pytest
from pyspark.sql import functions as F

from seglattice.__main__ import main
from seglattice.functions.sql import register
from seglattice.operators import lattice
from seglattice.operators.kernel import Kernel, compile_dictionary
from seglattice.operators.tokenizer import Tokenizer, explode_tokens, part_of_speech, reading
from seglattice.plans.latin import latin
from seglattice.schema import TOKENS
from seglattice.sources.text import split_lines, text_lines
from seglattice.streaming.jobs import tokenize_stream, windowed_counts, write_tokens

from . import naive
from .test_kernel import COMPAT, HERE, MINIMAL, USER

TEXTS = ["京都東京都京都", "", None, "東京 都", "本とカレー", "kampersanda é\n🍛", "東京都 " * 300]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)


def test_token_columns(spark, texts):
    for d, options in ((COMPAT, {}), (USER, {"ignore_space": True, "max_grouping": 9}), (MINIMAL, {})):
        tokenizer = Tokenizer(spark, d, **options)
        kernel = Kernel(compile_dictionary(d, **options))
        rows = texts.select("id", "t", tokenizer.tokenize("t").alias("w"), tokenizer.tokenize_spans("t").alias("s"), tokenizer.tokenize_count("t").alias("n"), tokenizer.path_cost("t").alias("c"), tokenizer.wakati("t").alias("k"))
        for r in rows.collect():
            if r["t"] is None:
                assert r["w"] is r["s"] is r["n"] is r["c"] is r["k"] is None
                continue
            want = naive.tokenize(d, r["t"], **options)
            assert [(w["start_char"], w["end_char"], w["word_id"], w["total_cost"]) for w in r["w"]] == want
            data = r["t"].encode()
            for w, s in zip(r["w"], r["s"], strict=True):
                assert data[w["start"] : w["end"]].decode() == w["surface"] == r["t"][w["start_char"] : w["end_char"]]
                assert (s["start"], s["end"], s["word_id"]) == (w["start"], w["end"], w["word_id"])
                assert w["feature"] == kernel.feature(w["word_id"]) == d.feature(w["word_id"]) and w["is_unknown"] == (w["word_id"] >= 1 << 31)
            assert r["n"] == len(want) and r["c"] == (want[-1][3] if want else 0)
            assert r["k"] == " ".join(w["surface"] for w in r["w"])
    assert rows.schema["w"].dataType.simpleString() == TOKENS


def test_output_formats(spark):
    tokenizer = Tokenizer(spark, MINIMAL)
    df = spark.createDataFrame([("本と\"\\\n\t\x01\x08",), ("",), (None,)], "t string").coalesce(1)
    register(spark, tokenizer)
    rows = df.select(tokenizer.mecab("t").alias("m"), tokenizer.json("t").alias("j"), F.expr("tok_mecab(t)").alias("m2"), F.expr("tok_json(t)").alias("j2")).collect()
    assert rows[0]["m"].startswith("本と\tcompound,book-and\n\"\tUNK\n") and rows[0]["m"].endswith("\nEOS") and rows[1]["m"] == "EOS" and rows[1]["j"] == "[]"
    first = json.loads(rows[0]["j"])[0]
    assert list(first.items()) == [("surface", "本と"), ("feature", "compound,book-and"), ("start", 0), ("end", 6), ("startChar", 0), ("endChar", 2), ("wordId", 3), ("totalCost", 1), ("unknown", False)]
    assert [r["m"] for r in rows] == [r["m2"] for r in rows] and json.loads(rows[0]["j2"]) == json.loads(rows[0]["j"])
    assert rows[0]["j2"] == rows[0]["j"].replace("\\u0001", "\\u0001") and rows[2]["j2"] is None
    pos = spark.createDataFrame([("名詞,固有名詞,*,一般,*,*,キョウト,京都,x",), ("*,*,*,*,*,*,*,*",), ("a",)], "f string").select(part_of_speech(F.col("f")), reading(F.col("f"))).collect()
    assert [tuple(r) for r in pos] == [("名詞-固有名詞-一般", "京都"), ("*,*,*,*,*,*,*,*", ""), ("a", "")]


def test_sql_functions(spark, texts):
    register(spark, Tokenizer(spark, COMPAT), "ja_")
    texts.createOrReplaceTempView("ja_texts")
    rows = spark.sql("SELECT id, ja_count(t) AS n, ja_wakati(t) AS w, size(ja_tokens(t)) AS m, ja_cost(t) AS c, size(ja_spans(t)) AS s FROM ja_texts WHERE id IN (0, 1) ORDER BY id").collect()
    assert tuple(rows[0]) == (0, 3, "京都 東京都 京都", 3, 16044, 3) and tuple(rows[1]) == (1, 0, "", 0, 0, 0)
    rows = spark.sql("SELECT id, position, surface, total_cost FROM ja_texts, LATERAL ja_rows(t) WHERE id IN (0, 2) ORDER BY position").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "京都", 5214), (0, 1, "東京都", 11103), (0, 2, "京都", 16044)]


def test_edges_hold_every_path(spark):
    """The lattice as DataFrames and the kernel's paths: the same words, and edges that a plain listing gives."""
    d = latin(user=True)
    texts = ["Thereas of the 12 é's, and - x", "", "a", "an anâb 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for limit in (0, 2):
        got = {(r["id"], r["start"], r["end"], r["word_id"]) for r in lattice.edges(df, "id", "t", d, limit).collect()}
        kernel = Kernel(compile_dictionary(d, max_grouping=limit))
        for i, t in enumerate(texts):
            assert all((i, a, b, w) in got for a, b, w, _ in kernel.tokenize(t))
            for a in range(len(t)):
                for k, e in enumerate(d.entries):
                    assert ((i, a, a + len(e.surface), k) in got) == t.startswith(e.surface, a)
    none = lattice.edges(df.limit(0), "id", "t", d)
    assert none.collect() == []


def test_text_job(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("東京 都\n\n京都\n", encoding="utf-8")
    files = [x for n, f in (("lex", "lex.csv"), ("matrix", "matrix.def"), ("char", "char.def"), ("unk", "unk.def")) for x in (f"--{n}", f"file://{HERE}/compat/{f}")]
    assert main([*files, "-S", "-O", "wakati", f"file://{tmp_path}/in.txt"], spark) == 0
    assert capsys.readouterr().out == "東京 都\n\n京都\n"
    assert main([*files, "--user", f"file://{HERE}/compat/user.csv", f"file://{tmp_path}/in.txt", "--output", f"file://{tmp_path}/out"], spark) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).count("EOS\n") == 3
    small = [x if "lex" not in x or x == "--lex" else f"file://{HERE}/compat/char.def" for x in files]
    assert main([*small, f"file://{tmp_path}/in.txt"], spark) == 1 and capsys.readouterr().err


def test_streams_equal_batches(spark, tmp_path):
    tokenizer = Tokenizer(spark, latin())
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    half = batch.withColumn("k", F.pmod("event_id", F.lit(2)))
    for k in (0, 1):
        half.where(f"k = {k}").drop("k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = write_tokens(stream.select("event_id", "props"), tokenizer, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "props")
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r["event_id"], r["tokens"]) for r in df.select("event_id", "tokens").collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(tokenize_stream(batch.select("event_id", "props"), tokenizer, "props"))
    counted = windowed_counts(stream, tokenizer, time="ts", text="props", window="1 hour", by="event_type").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    want = windowed_counts(batch, tokenizer, time="ts", text="props", window="1 hour", by="event_type")
    assert sorted(map(str, spark.table("counted").collect())) == sorted(map(str, want.collect()))


def test_exploded_rows_keep_other_columns(spark, texts):
    rows = explode_tokens(texts.withColumn("w", Tokenizer(spark, COMPAT).tokenize("t")), "w", "id").where("id = 0").orderBy("position").collect()
    assert [(r["id"], r["position"], r["surface"]) for r in rows] == [(0, 0, "京都"), (0, 1, "東京都"), (0, 2, "京都")]


def test_lines(spark, tmp_path):
    df = spark.createDataFrame([("a\r\n\nb\n",), ("",), ("x",), ("\n",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(split_lines("t")).collect()] == [["a", "", "b"], [], ["x"], [""], None]
    (tmp_path / "in.txt").write_bytes("東京\r\n\nx\n".encode())
    assert [r["line"] for r in text_lines(spark, f"file://{tmp_path}/in.txt").collect()] == ["東京", "", "x"]
