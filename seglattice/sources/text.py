"""Text lines: from files (gzip and other encodings included) and from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, line) of text files: one row for each line, CR LF or LF ended."""
    reader = spark.read.option("lineSep", "\n")
    lines = reader.text(path) if encoding is None else reader.option("encoding", encoding).text(path)
    return lines.select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))


def split_lines(text: Column | str) -> Column:
    """The lines of a text column; the piece after a final line end is none, empty lines between are kept."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n"))
