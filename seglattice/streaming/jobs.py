"""The tokenizer's columns on streaming DataFrames.

Segmentation works row by row, so the same columns run on a stream as they are. Windowed counts of words are an
extension of this engine: event-time windows with a watermark, so that state is dropped as it ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokenizer import Tokenizer


def tokenize_stream(stream: DataFrame, tokenizer: Tokenizer, text: str = "text", name: str = "tokens") -> DataFrame:
    """The stream with a token column."""
    return stream.withColumn(name, tokenizer.tokenize(text))


def windowed_counts(stream: DataFrame, tokenizer: Tokenizer, *, time: str, text: str, window: str = "10 minutes", lateness: str = "10 minutes", by: str | None = None) -> DataFrame:
    """(window_start, [by], rows, words) of a stream or a table with an event time."""
    # watermarks take instants; a time without a zone is one of the session's zone
    counted = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("_words", tokenizer.tokenize_count(text))
    if stream.isStreaming:
        counted = counted.withWatermark(time, lateness)
    keys = [F.window(time, window).alias("w"), *([F.col(by)] if by else [])]
    return counted.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("_words").alias("words")).select(F.col("w.start").alias("window_start"), *([by] if by else []), "rows", "words")


def write_tokens(stream: DataFrame, tokenizer: Tokenizer, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Append tokenized rows to Parquet as they come; the checkpoint makes each batch count once."""
    return tokenize_stream(stream, tokenizer, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
