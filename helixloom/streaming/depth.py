"""Streaming forms of the position-ordered steps: depth and evidence over a stream of reads, late reads dropped.

A read's place stands for event time: place p of contig t is the instant t days and p milliseconds after the epoch, so
contigs do not overlap for lengths below 86.4 million; scale widens that. The watermark is the head position less
the lag, as a staged scan keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_time(tid: str = "tid", pos: str = "pos0", scale: int = 4) -> Column:
    """Place as a timestamp; scale places share a millisecond."""
    return F.timestamp_millis(F.col(tid).cast("long") * 86_400_000 + F.floor(F.col(pos) / scale).cast("long"))


def windowed_depth(reads: DataFrame, window: int = 1000, lag: int = 10_000, scale: int = 4) -> DataFrame:
    """Reads and bases of each window of places, final once the head is `lag` places past it. Works on batch and stream alike."""
    timed = reads.withColumn("_at", place_time(scale=scale)).withWatermark("_at", f"{lag // scale} milliseconds")
    out = timed.groupBy("sample", F.window("_at", f"{window // scale} milliseconds")).agg(F.count("*").alias("n"), F.sum("length").alias("bases"))
    start = F.unix_millis("window.start")
    return out.select("sample", F.floor(start / 86_400_000).cast("int").alias("tid"), ((start % 86_400_000) * scale).alias("begin"), "n", "bases")


def covered_sessions(reads: DataFrame, gap: int = 1000, lag: int = 10_000, scale: int = 4) -> DataFrame:
    """Runs of reads without a gap of `gap` places between their starts."""
    timed = reads.withColumn("_at", place_time(scale=scale)).withWatermark("_at", f"{lag // scale} milliseconds")
    out = timed.groupBy("sample", F.session_window("_at", f"{gap // scale} milliseconds")).agg(F.count("*").alias("n"))
    start, end = F.unix_millis("session_window.start"), F.unix_millis("session_window.end")
    return out.select("sample", F.floor(start / 86_400_000).cast("int").alias("tid"), ((start % 86_400_000) * scale).alias("begin"), ((end % 86_400_000) * scale - gap).alias("last"), "n")


def evidence_counts(reads: DataFrame, lag: int = 10_000, scale: int = 4) -> DataFrame:
    """Running counters of each sample (columns of operators.reads.evidence)."""
    n = lambda c: F.count_if(F.col(c))
    return reads.groupBy("sample").agg(F.count("*").alias("total"), n("is_anomalous").alias("anom"), n("is_split").alias("split"), n("is_indel").alias("indel"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a streaming result as Parquet until all input there is has been read."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
