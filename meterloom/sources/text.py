"""Lines of the text protocol from files, batch or stream; and samples from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.protocol import parse_lines
from meterloom.sources.binary import sequence


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq): one row per line; seq follows the order within a file and, by path, between files."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.make_valid_utf8("value").alias("line"), F.monotonically_increasing_id().alias("seq"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream: every file that appears under path is read once."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(F.make_valid_utf8("value").alias("line"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(read_lines(spark, path))


def split_datagrams(datagrams: DataFrame, data: str = "data", order: str = "chunk_no") -> DataFrame:
    """(line, seq) of datagrams; a missing final newline is supplied by the split."""
    text = F.make_valid_utf8(F.col(data).cast("string"))
    x = datagrams.select(F.col(order).alias("_no"), F.posexplode(F.split(text, "\n")).alias("_pos", "line"))
    return x.where("line <> ''").select("line", sequence(F.col("_no"), F.col("_pos")).alias("seq"))
