"""Segments of contigs, groups of segments and regions, mostly as expressions over the small contig table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals

SEGMENT = 12_000_000
CLUMP = 200_000


def segments(contigs: DataFrame, size: int = SEGMENT, label: str = "label", length: str = "length", order: str = "tid") -> DataFrame:
    """Near-equal segments of each contig of at most `size` bases: 1-based closed begin and end, and the segment's number in its contig."""
    n = F.expr(f"1 + ({length} - 1) div {size}")
    df = contigs.where(F.col(length) > 0).withColumn("_n", n).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    base, extra = F.expr(f"{length} div _n"), F.expr(f"{length} % _n")
    begin = F.col("segment") * base + F.least("segment", extra) + 1
    end = (F.col("segment") + 1) * base + F.least(F.col("segment") + 1, extra)
    return df.select(order, label, "segment", begin.cast("long").alias("begin"), end.cast("long").alias("end"))


def grouped(rows: list[tuple[str, int]], clump: int = CLUMP) -> list[list[str]]:
    """Segments (name, size) in order, small successive ones together up to `clump` bases. The table of contigs is small."""
    out: list[list[str]] = []
    size = 0
    for name, n in rows:
        if out and size + n <= clump:
            out[-1].append(name)
            size += n
        else:
            out.append([name])
            size = n
    return out


def contig_groups(contigs: list[tuple[str, int]], skipped=frozenset(), clump: int = CLUMP) -> list[list[str]]:
    """Groups of contigs for depth estimation, fully excluded ones left out."""
    return grouped([c for c in contigs if c[0] not in skipped], clump)


_REGION = re.compile(r"^(.+):([0-9,]+)-([0-9,]+)$")


def parse_region(text: str, lengths: dict[str, int]) -> tuple[str, int, int]:
    """label, begin and end (0-based half-open) of 'label' or 'label:begin-end' (1-based closed). The last ':' counts, as labels may hold one."""
    if text in lengths:
        return text, 0, lengths[text]
    m = _REGION.match(text)
    if not m or m[1] not in lengths:
        raise ValueError(f"Can't parse region {text!r}")
    begin, end = int(m[2].replace(",", "")), int(m[3].replace(",", ""))
    if not 1 <= begin <= end:
        raise ValueError(f"Empty or inverted region {text!r}")
    return m[1], begin - 1, min(end, lengths[m[1]])


def regions(df: DataFrame, contigs: DataFrame, text: str = "region") -> DataFrame:
    """Adds label, begin and end (0-based half-open) of region strings, as column expressions; bad ones raise."""
    known = contigs.select("label", "length")
    split = df.withColumn("_label", F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", 1))
    split = split.withColumn("_label", F.when(F.col("_label") == "", F.col(text)).otherwise(F.col("_label")))
    joined = split.join(F.broadcast(known), F.col("_label") == F.col("label"), "left")
    ok = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("Can't parse region "), F.col(text))).cast("string")).otherwise(F.col("label"))
    number = lambda k: F.nullif(F.regexp_extract(text, r"^(.+):([0-9]+)-([0-9]+)$", k), F.lit("")).cast("long")
    whole = F.col("label") == F.col(text)
    return joined.select(*df.columns, ok.alias("label"), F.when(whole, 0).otherwise(number(2) - 1).alias("begin"), F.when(whole, F.col("length")).otherwise(F.least(number(3), "length")).cast("long").alias("end"))


def callable_regions(regions: DataFrame, bed: DataFrame) -> DataFrame:
    """The parts of regions (label, begin, end) that lie in the merged ranges of a BED table (chrom, begin, end)."""
    merged = intervals.merged(bed, ("chrom",), touching=True).select("chrom", F.col("begin").alias("b_begin"), F.col("end").alias("b_end"))
    hit = intervals.overlap_join(regions, merged, left_cols=("label", "begin", "end"), right_cols=("chrom", "b_begin", "b_end"))
    return hit.select("label", F.greatest("begin", "b_begin").alias("begin"), F.least("end", "b_end").alias("end"))


def skipped_contigs(contigs: DataFrame, bed: DataFrame) -> DataFrame:
    """Contigs without any callable range."""
    return contigs.join(bed.select(F.col("chrom").alias("label")).distinct(), "label", "left_anti")


def depth_segments(length: int, start: int = 2_000_000, most: int = 20) -> int:
    """Size of the segments that a contig's depth is sampled by: doubled until there are at most `most`."""
    size = start
    while -(-length // size) > most:
        size *= 2
    return size


def contig_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contigs (label, length, and tid for the order) that two headers do not share: no rows if they are compatible."""
    cols = ["tid", "label", "length"]
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("right")))


def merged_streams(*tables: DataFrame) -> DataFrame:
    """Alignments of several samples, in order of place within each partition of a contig."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.repartition("tid", F.expr(f"pos0 div {SEGMENT}")).sortWithinPartitions("tid", "pos0", "sample", "qname")


#: Estimated bytes of a table that one task takes, where a step holds or sorts all rows of its task.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its estimated size asks for, so that a task's share stays the same as df grows.

    Small tables stay as they are, and so do those whose size Spark does not know, or estimates as a product of two.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    unknown = size >= 1 << 60 or "Join" in plan.toString()
    n = min(size // TASK_BYTES, 1 << 16)
    return df if n < 2 or unknown else df.repartition(n, *keys)
