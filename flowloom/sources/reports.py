"""Report sinks: one folder of text lines for each epoch, and metrics rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalars import dotted


def report_lines(found: DataFrame, threshold: int) -> DataFrame:
    """epoch, line: both addresses and the threshold."""
    return found.select("epoch", F.concat(dotted(F.col("src_ip")), F.lit("/"), dotted(F.col("dst_ip")), F.lit(f" {threshold}")).alias("line"))


def write_reports(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Folders epoch=n with text files; rewriting an epoch replaces it alone, so a repeated batch leaves one copy."""
    lines.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("epoch").text(path)


def search_load(df: DataFrame, module: str) -> DataFrame:
    """module, metric, value: rows that a module has looked at."""
    return df.agg(F.count("*").alias("value")).select(F.lit(module).alias("module"), F.lit("SearchLoad").alias("metric"), "value")


def ticks(df: DataFrame, length: int) -> DataFrame:
    """epoch, seq: the packets that close an epoch (the first packet closes an empty one)."""
    return df.where(F.col("seq") % length == 0).select("epoch", "seq")


def hex_dump(df: DataFrame) -> DataFrame:
    """seq, text: source and destination as hexadecimal words."""
    return df.select("seq", F.format_string("%08x -> %08x", "src_ip", "dst_ip").alias("text"))
