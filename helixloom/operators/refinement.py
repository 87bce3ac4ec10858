"""Refinement of local candidates: reads about a candidate are assembled, contigs aligned, and breakends made exact.

Each candidate is assembled by one call over at most 1000 reads (see functions.assembly); candidates are spread over
tasks by their keys. The reference comes in pieces (sources.text.chunked) whose margin must cover a region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assembly, cigar
from ..sources.text import region_bases
from . import intervals, stats
from . import reads as R

KEYS = ["locus", "n1", "n2", "cand"]
#: Bases about a candidate that are assembled and aligned to, the widest candidate, and bases at each side of a tested breakend.
PAD, WIDEST, FLANK = 700, 10_000, 200


def regions(calls: DataFrame, pad: int = PAD, widest: int = WIDEST) -> DataFrame:
    """keys, tid, begin and end of the same-contig candidates that are not too wide."""
    low, high = F.least("bp1_begin", "bp2_begin"), F.greatest("bp1_end", "bp2_end")
    local = calls.where((F.col("bp1_tid") == F.col("bp2_tid")) & (high - low <= widest))
    return local.select(*KEYS, F.col("bp1_tid").alias("g_tid"), F.greatest(F.lit(0), low - pad).cast("int").alias("g_begin"), (high + pad).cast("int").alias("g_end"))


def with_bases(found: DataFrame, pieces: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Regions with ref, their bases, and offset, where these begin."""
    own = pieces.select(F.col("tid").alias("g_tid"), F.col("chunk").alias("_chunk"), F.col("offset").alias("_offset"), F.col("bases").alias("_bases"))
    joined = found.withColumn("_chunk", F.expr(f"g_begin div {size}").cast("int")).join(own, ["g_tid", "_chunk"])
    return joined.select(*KEYS, "g_tid", F.col("g_begin").alias("offset"), region_bases(F.col("_bases"), F.col("_offset"), F.col("g_begin"), F.col("g_end")).alias("ref"))


def assembly_reads(ready: DataFrame, found: DataFrame, least: int = 4) -> DataFrame:
    """keys and seq of the reads in each region that hint at a variant: indels, clipped ends or a split."""
    clip = F.greatest(cigar.soft_clip_lead(F.col("path")), cigar.soft_clip_trail(F.col("path"))) >= least
    use = ready.where(~R.mapped_filtered() & (R.local_indel(least) | clip | F.col("is_split")))
    spans = use.select("tid", F.col("pos0").alias("r_begin"), (F.col("pos0") + cigar.ref_length(F.col("path"))).alias("r_end"), "seq")
    return intervals.overlap_join(spans, found, left_cols=("tid", "r_begin", "r_end"), right_cols=("g_tid", "g_begin", "g_end")).select(*KEYS, "seq")


def refined(calls: DataFrame, ready: DataFrame, pieces: DataFrame, options: assembly.Options = assembly.Options(), least: int = 8) -> DataFrame:
    """keys, tid, pos, deleted, inserted, homology, n_support, offset and ref of each candidate's best assembled variant."""
    found = regions(calls)
    based = with_bases(found, pieces)
    contigs = assembly.assembled(assembly_reads(ready, found), KEYS, options=options)
    variants = assembly.refine(contigs, based.select(*KEYS, "offset", "ref"), KEYS, least)
    best = stats.best_of_group(variants, KEYS, F.col("score").desc(), F.col("n_support").desc(), "contig", "pos")
    return best.join(based, KEYS).withColumnRenamed("g_tid", "tid")


def alleles(exact: DataFrame, flank: int = FLANK) -> DataFrame:
    """event, junction, allele, bp, target, begin and end: the sequences that split reads are tested against."""
    at = F.col("pos") - F.col("offset")
    cut = lambda a, n: F.substring("ref", F.greatest(a, F.lit(0)) + 1, n)
    left, right = cut(at - flank, F.lit(flank)), cut(at + F.col("deleted"), F.lit(flank) + F.col("homology"))
    alt = F.concat(left, "inserted", right)
    hom, first = F.col("homology"), F.length(left) - 1
    row = lambda allele, bp, target, begin: F.struct(F.lit(allele).alias("allele"), F.lit(bp).alias("bp"), target.alias("target"), begin.alias("begin"), (begin + hom).alias("end"))
    rows = F.array(
        row("ref", 1, cut(at - flank, F.lit(2 * flank) + hom), first),
        row("ref", 2, cut(at + F.col("deleted") - flank, F.lit(2 * flank) + hom), F.lit(flank - 1)),
        row("alt", 1, alt, first),
        row("alt", 2, alt, first + F.length("inserted")),
    )
    return exact.select("event", "junction", F.explode(rows).alias("_a")).select("event", "junction", "_a.*")


def exact_junctions(exact: DataFrame) -> DataFrame:
    """The breakends of refined variants, as support.split_reads takes them."""
    return exact.select(
        "event", "junction", F.col("tid").alias("b_tid1"), F.col("pos").alias("b_begin1"), (F.col("pos") + 1).alias("b_end1"),
        F.col("tid").alias("b_tid2"), (F.col("pos") + F.col("deleted")).alias("b_begin2"), (F.col("pos") + F.col("deleted") + 1).alias("b_end2"),
    )


def indels(exact: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows for vcf.indel_rows of refined variants with id, qual and filter."""
    before = F.col("pos") - F.col("offset") - 1
    kind = F.when(F.col("deleted") >= F.length("inserted"), "DELETE").otherwise("INSERT")
    named = F.broadcast(contigs.select("tid", F.col("label").alias("chrom")))
    return exact.join(named, "tid").select(
        "id", kind.alias("kind"), "chrom", (F.col("pos") - 1).alias("pos"), (F.col("pos") + F.col("deleted")).alias("end"), F.substring("ref", before + 1, F.col("deleted") + 1).alias("ref"),
        F.col("inserted").alias("insert_seq"), F.lit(False).alias("imprecise"), F.substring("ref", before + 2, F.col("homology")).alias("homology"), "qual", "filter",
    )
