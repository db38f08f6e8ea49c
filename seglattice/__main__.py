"""A text job: python -m seglattice --lex FILE --matrix FILE --char FILE --unk FILE [--user FILE] [-S] [-M N] [-O mecab|wakati] [TEXT ...].

Tokenizes the lines of text files (standard input without any) and prints them in order, one block for each line.
With --output the blocks are written as text files by the executors instead, one for each partition.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.tokenizer import Tokenizer
from .schema import DictionaryError
from .sources.dictionary import Dictionary, lines, read_text
from .sources.text import text_lines


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="seglattice", description="Least-cost segmentation of lines of text.")
    for name in ("lex", "matrix", "char", "unk"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--user", help="user lexicon")
    p.add_argument("-S", "--ignore-space", action="store_true")
    p.add_argument("-M", "--max-grouping-len", type=int, default=0)
    p.add_argument("-O", "--output-mode", choices=("mecab", "wakati"), default="mecab")
    p.add_argument("--output", help="folder for text files instead of standard output")
    p.add_argument("texts", nargs="*")
    return p.parse_args(argv)


def formatted(df: DataFrame, tokenizer: Tokenizer, mode: str, text: str) -> DataFrame:
    return df.withColumn("block", tokenizer.mecab(text) if mode == "mecab" else tokenizer.wakati(text))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("seglattice").getOrCreate() if spark is None else spark
    try:
        d = Dictionary.from_mecab_text(*(read_text(spark, getattr(options, n)) for n in ("lex", "matrix", "char", "unk")))
        if options.user:
            d = d.with_user_lexicon(read_text(spark, options.user))
        tokenizer = Tokenizer(spark, d, ignore_space=options.ignore_space, max_grouping=options.max_grouping_len)
    except DictionaryError as e:
        print(e, file=sys.stderr)
        return 1
    if options.texts:
        source = None
        for path in options.texts:
            own = text_lines(spark, path)
            source = own if source is None else source.unionByName(own)
    else:
        own = lines(sys.stdin.read())
        source = spark.createDataFrame([("-", line) for line in own], "file string, line string")
    out = formatted(source, tokenizer, options.output_mode, "line").select("block")
    if options.output:
        out.write.text(options.output)
    else:
        for row in out.toLocalIterator():  # in the order of files and lines
            print(row["block"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
