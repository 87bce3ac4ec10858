"""Read filters and evidence classes: every test is a column expression over the alignments table.

Per-sample limits (pp_min and pp_max, the proper-pair bounds of the fragment size) are joined as columns first;
the table of samples has one row for each input file and is small by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar
from . import stats


@dataclass(frozen=True)
class Options:
    min_mapq: int = 15
    min_tier2_mapq: int = 5
    min_candidate_size: int = 8
    breakend_size: int = 40
    proper_pair_trim: float = 0.01
    breakend_trim: float = 0.25
    min_semi_aligned: int = 8
    max_local_assembly_size: int = 30
    shadow_min_quality: float = 25.0
    remote_distance: int = 10_000


PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENT = (1 << i for i in range(12))


def has(bit: int, flag: Column | str = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bit) != 0


def with_flags(reads: DataFrame) -> DataFrame:
    """Adds the flag predicates as boolean columns and the parsed path."""
    out = reads.withColumns(
        {
            "is_paired": has(PAIRED), "is_unmapped": has(UNMAPPED), "is_mate_unmapped": has(MATE_UNMAPPED), "is_fwd": ~has(REVERSE), "is_mate_fwd": ~has(MATE_REVERSE),
            "is_first": has(FIRST), "is_second": has(SECOND), "is_secondary": has(SECONDARY), "is_qc_fail": has(QC_FAIL), "is_duplicate": has(DUPLICATE), "is_supplement": has(SUPPLEMENT),
            "is_split": F.col("sa").isNotNull(), "path": cigar.parse(F.col("cigar")),
        }
    )
    return out.withColumn("is_non_strict_supplement", F.col("is_supplement") | (F.col("is_secondary") & F.col("is_split")))


def core_filtered() -> Column:
    """Reads that no step uses: failed, duplicate, or supplementary or secondary without a split tag."""
    return F.col("is_qc_fail") | F.col("is_duplicate") | ((F.col("is_supplement") | F.col("is_secondary")) & ~F.col("is_split"))


def mapped_filtered() -> Column:
    return core_filtered() | F.col("is_unmapped")


def invalid_reason() -> Column:
    """Why a record is malformed, or null."""
    return (
        F.when(F.col("seq").isNull() | (F.col("seq") == "*"), "no sequence")
        .when(F.col("seq").contains("="), "illegal base '='")
        .when(~F.col("is_unmapped") & (cigar.read_length(F.col("path")) != F.length("seq")), "alignment and sequence differ in length")
    )


def checked(reads: DataFrame) -> DataFrame:
    """reads, raising on the first malformed record."""
    why = invalid_reason()
    return reads.where(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("Bad alignment record: "), why, F.lit(" in "), F.col("qname"))).cast("boolean")).otherwise(True))


def mapped_pair() -> Column:
    return F.col("is_paired") & ~F.col("is_unmapped") & ~F.col("is_mate_unmapped")


def same_contig_pair() -> Column:
    return mapped_pair() & (F.col("tid") == F.col("mate_tid"))


def innie() -> Column:
    """Opposite strands, with the forward read not to the right of the other."""
    forward = F.when(F.col("is_fwd"), F.col("pos0")).otherwise(F.col("mate_pos0"))
    reverse = F.when(F.col("is_fwd"), F.col("mate_pos0")).otherwise(F.col("pos0"))
    return same_contig_pair() & (F.col("is_fwd") != F.col("is_mate_fwd")) & (forward <= reverse)


def size_class() -> Column:
    size = F.abs("tlen")
    known = F.when(size < F.col("pp_min"), "COMPRESSED").when(size <= F.col("pp_max"), "NORMAL").when(size < F.floor(F.col("pp_max") * 4), "CLOSE").otherwise("DISTANT")
    return F.when(F.col("tid") != F.col("mate_tid"), "DISTANT").when(size == 0, "UNKNOWN").otherwise(known)


def anomalous() -> Column:
    """Mapped pairs of odd orientation or size."""
    size = F.abs("tlen")
    return mapped_pair() & (~innie() | (size == 0) | (size > F.floor(F.col("pp_max") * 1.5)) | (size < F.col("pp_min")))


def non_compressed_anomalous() -> Column:
    return mapped_pair() & anomalous() & (~innie() | ~size_class().isin("NORMAL", "COMPRESSED"))


def local_indel(least: Column | int) -> Column:
    return F.exists("path", lambda s: s["op"].isin("I", "D") & (s["len"] >= least))


def mate_path() -> Column:
    """The mate's path by its tag, or the read's length as a match."""
    return cigar.parse(F.coalesce(F.col("mc"), F.concat(F.length("seq").cast("string"), F.lit("M"))))


def overlapping_pair() -> Column:
    """Innie pairs whose reads overlap, so that interior edges may be adapter."""
    ref_end = F.col("pos0") + cigar.ref_length(F.col("path"))
    mate_end = F.col("mate_pos0") + cigar.ref_length(mate_path())
    return innie() & F.when(F.col("is_fwd"), ref_end >= F.col("mate_pos0") + 1).otherwise(mate_end >= F.col("pos0") + 1)


def adapter_pair() -> Column:
    """Overlapping pairs that read through the fragment: by the mate's tag exactly, else by a 3' soft clip."""
    ref_end = F.col("pos0") + cigar.ref_length(F.col("path"))
    clip = F.when(F.col("is_fwd"), cigar.soft_clip_trail(F.col("path"))).otherwise(cigar.soft_clip_lead(F.col("path")))
    own_end = F.when(F.col("is_fwd"), ref_end + clip).otherwise(F.col("pos0") - clip)
    mate = mate_path()
    mate_edge = F.when(F.col("is_fwd"), F.col("mate_pos0") + cigar.ref_length(mate) + cigar.soft_clip_trail(mate)).otherwise(F.col("mate_pos0") - cigar.soft_clip_lead(mate))
    exact = F.when(F.col("is_fwd"), own_end > mate_edge).otherwise(own_end < mate_edge)
    return overlapping_pair() & F.when(F.col("mc").isNotNull(), exact).otherwise(clip > 0)


def evidence(reads: DataFrame, options: Options = Options(), semi_aligned: Column | None = None) -> DataFrame:
    """Adds is_anomalous, is_indel, is_semi_aligned and is_evidence. semi_aligned: the longer poorly aligned edge, if known."""
    small = options.min_candidate_size <= options.max_local_assembly_size
    semi = F.lit(False) if semi_aligned is None or not small else ~F.col("is_split") & (semi_aligned >= options.min_semi_aligned)
    out = reads.withColumn("is_anomalous", F.coalesce(non_compressed_anomalous(), F.lit(False))).withColumn("is_indel", local_indel(options.min_candidate_size)).withColumn("is_semi_aligned", semi)
    return out.withColumn("is_evidence", F.col("is_anomalous") | F.col("is_split") | F.col("is_indel") | F.col("is_semi_aligned"))


def sample_counts(reads: DataFrame, options: Options = Options(), keys=("sample",)) -> DataFrame:
    """Counters of each sample over reads that pass the mapped filter (columns of evidence())."""
    use = F.col("mapq") >= options.min_mapq
    n = lambda c: F.count_if(use & c)
    split_supplement = F.col("is_split") & F.col("is_non_strict_supplement")
    return reads.groupBy(*keys).agg(
        F.count_if(~use).alias("min_mapq"),
        n(F.lit(True)).alias("total"),
        n(~F.col("is_evidence")).alias("ignored"),
        n(F.col("is_anomalous")).alias("anom"),
        n(F.col("is_split")).alias("split"),
        n(F.col("is_anomalous") & F.col("is_split")).alias("anom_and_split"),
        n(F.col("is_indel")).alias("indel"),
        n(F.col("is_indel") | F.col("is_semi_aligned")).alias("assm"),
        n(F.coalesce(mate_insertion(options), F.lit(False))).alias("remote"),
        n(split_supplement).alias("split_supp"),
    )


def mate_insertion(options: Options = Options()) -> Column:
    """Mapped pairs whose mate lies on another contig or far away."""
    return mapped_pair() & (F.col("mapq") >= options.min_mapq) & ((F.col("tid") != F.col("mate_tid")) | (F.abs(F.col("pos0") - F.col("mate_pos0")) >= options.remote_distance))


def shadows(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Unmapped reads of good quality whose mate is mapped, with the mate's place as anchor_tid and anchor_pos0."""
    quality = F.aggregate("qual", F.lit(0.0), lambda a, q: a + q) / F.size("qual")
    lost = reads.where("is_paired AND is_unmapped AND NOT is_mate_unmapped AND NOT is_supplement AND NOT is_secondary").where(quality >= options.shadow_min_quality)
    anchor = reads.where(~mapped_filtered() & F.col("is_mate_unmapped") & (F.col("mapq") >= options.min_mapq) & ~F.col("is_supplement") & ~F.col("is_secondary"))
    anchor = anchor.select("sample", "qname", F.col("is_first").alias("_first"), F.col("tid").alias("anchor_tid"), F.col("pos0").alias("anchor_pos0"), F.col("is_fwd").alias("anchor_fwd"))
    return lost.join(anchor, ["sample", "qname"]).where(F.col("is_first") != F.col("_first")).drop("_first")


def insert_size_reads(reads: DataFrame) -> DataFrame:
    """Reads that the fragment-size estimate uses: simple alignments, one fragment for each start, both mates seen.

    Of the fragments that start at one place the first by name counts. A simple alignment is matches with at most
    one skip, and a clip at the 3' end only.
    """
    ops = F.transform("path", lambda s: s["op"])
    simple = F.array_join(F.when(F.col("is_fwd"), ops).otherwise(F.reverse(ops)), "").rlike("^[M=X]+(?:N[M=X]+)?[SH]?$")
    use = reads.where(~mapped_filtered() & ~F.col("is_supplement") & ~F.col("is_secondary") & same_contig_pair() & (F.col("mapq") != 0) & ~F.col("is_split") & simple)
    w = Window.partitionBy("sample", "tid", "pos0", "is_fwd").orderBy("qname", "flag")
    use = use.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    both = F.count("*").over(Window.partitionBy("sample", "qname"))
    return use.withColumn("_mates", both).where("_mates > 1 AND tlen > 0").drop("_mates")


def pair_orientation() -> Column:
    """F or R for the left read's strand, m or p for whether the other has the same: Fm, Fp, Rm or Rp (innie)."""
    left_fwd = F.when(F.col("pos0") <= F.col("mate_pos0"), F.col("is_fwd")).otherwise(F.col("is_mate_fwd"))
    same = F.col("is_fwd") == F.col("is_mate_fwd")
    return F.when(same, F.when(F.col("is_fwd"), "Fp").otherwise("Fm")).otherwise(F.when(left_fwd, "Rp").otherwise("Rm"))


def sample_limits(histogram: DataFrame, options: Options = Options(), keys=("sample",)) -> DataFrame:
    """The bounds of each sample that classification needs, from its fragment-size histogram (size, n)."""
    cdf = stats.size_cdf(histogram, keys)
    q = lambda p, name: stats.quantile(cdf, keys, p).select(*keys, F.col("size").alias(name))
    out = q(options.proper_pair_trim, "pp_min")
    for p, name in ((1 - options.proper_pair_trim, "pp_max"), (options.breakend_trim, "be_min"), (1 - options.breakend_trim, "be_max")):
        out = out.join(q(p, name), list(keys))
    return out.withColumn("large_low", F.col("pp_max") * 10).withColumn("large_high", F.col("pp_max") * 20)


def depth_filtered(reads: DataFrame, windows: DataFrame, chrom_depth: DataFrame, factor: float = 12.0) -> DataFrame:
    """Adds is_deep: the depth at the read's start is above factor times its contig's depth.

    windows has tid, begin, end, depth (a coverage table); total depth is used, so the order of reads plays no part.
    """
    from .intervals import BIN, block_hulls

    limits = F.broadcast(chrom_depth.select("tid", F.col("depth").alias("_limit")))  # a row for each contig
    deep = windows.join(limits, "tid").where(F.col("depth") > F.col("_limit") * factor)
    # hulls are cut at the ends of bins, so that a read's start lies in one bin and meets one row, whatever lies there
    bin_of = lambda c: F.expr(f"CAST(floor({c} / {BIN}) AS BIGINT)")
    cut = block_hulls(deep, touching=True).where("begin < end").withColumn("_bin", F.explode(F.sequence(bin_of("begin"), bin_of("(end - 1)"))))
    pieces = cut.groupBy("tid", "_bin").agg(F.collect_set(F.struct("begin", "end")).alias("_pieces")).withColumnRenamed("tid", "_tid")
    hit = F.exists("_pieces", lambda p: (p["begin"] <= F.col("pos0")) & (F.col("pos0") < p["end"]))
    out = reads.withColumn("_at", bin_of("pos0")).join(pieces, (F.col("tid") == F.col("_tid")) & (F.col("_at") == F.col("_bin")), "left")
    return out.withColumn("is_deep", F.coalesce(hit, F.lit(False))).drop("_at", "_tid", "_bin", "_pieces")
