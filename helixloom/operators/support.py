"""Evidence of fragments for and against junctions: pairs that span them, pairs that span the reference, split reads.

The result is the evidence table of operators.scoring. Breakends meet fragments by overlap joins; fragment sizes are
looked up in the sample's size distribution by an equi-join on every size between its least and largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import align, cigar
from . import intervals, scoring, stats
from . import reads as R

#: Bases that a pair must have on both sides of a breakend, and the least fragment probability that supports an allele.
MIN_SIDE, MIN_PROBABILITY = 50, 1e-4
KEYS = ["event", "junction"]


def size_shares(histogram: DataFrame) -> DataFrame:
    """sample, size and share (of fragments at most this size), for each size from the least to the largest seen."""
    cdf = stats.size_cdf(histogram, ["sample"])
    ahead = F.coalesce(F.lead("size").over(Window.partitionBy("sample").orderBy("size")), F.col("size") + 1)
    return cdf.withColumn("_to", ahead).select("sample", F.explode(F.sequence("size", F.col("_to") - 1)).alias("size"), (F.col("below") / F.col("total")).alias("share"))


def with_probability(df: DataFrame, shares: DataFrame, size: str, name: str) -> DataFrame:
    """Adds how likely a fragment of this size is, by the folded distribution: 0 beyond its ends."""
    own = shares.select("sample", F.col("size").cast("long").alias(size), F.least("share", 1 - F.col("share")).alias(name))
    return df.join(own, ["sample", size], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def fragments(ready: DataFrame) -> DataFrame:
    """One row for each pair with both reads: places, ends, strands and qualities of the first and second read by place."""
    use = ready.where(~R.mapped_filtered() & ~F.col("is_non_strict_supplement") & R.mapped_pair())
    place = F.struct("tid", "pos0", (F.col("pos0") + cigar.ref_length(F.col("path"))).alias("end"), "is_fwd", "mapq", "is_second")
    both = use.groupBy("sample", "qname").agg(F.array_sort(F.collect_set(place)).alias("_r"), F.max("pp_min").alias("pp_min"), F.max("pp_max").alias("pp_max")).where("size(_r) = 2")
    side = lambda k: [F.get("_r", F.lit(k))[x].alias(f"{n}{k + 1}") for x, n in (("tid", "tid"), ("pos0", "pos"), ("end", "end"), ("is_fwd", "fwd"), ("mapq", "mapq"), ("is_second", "second"))]
    return both.select("sample", "qname", "pp_min", "pp_max", *side(0), *side(1))


def junctions(calls: DataFrame) -> DataFrame:
    """event, junction, breakend centres and states, and the size of each candidate."""
    c = lambda k: intervals.center(F.col(f"bp{k}_begin"), F.col(f"bp{k}_end"))
    event = F.concat_ws(":", "locus", "n1", "n2", "event")
    return calls.select(
        event.alias("event"), F.col("cand").alias("junction"), *[F.col(f"bp{k}_{x}").alias(f"{n}{k}") for k in (1, 2) for x, n in (("tid", "b_tid"), ("begin", "b_begin"), ("end", "b_end"), ("state", "b_state"))],
        c(1).alias("c1"), c(2).alias("c2"), F.abs(c(2) - c(1)).alias("size"), (F.col("bp1_tid") == F.col("bp2_tid")).alias("same_contig"), "kind", "locus", "n1", "n2", "cand",
    )


def alt_pairs(found: DataFrame, pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """Pairs whose reads point at both breakends, from within reach of them: alt_pair by the size that the junction gives them.

    One row for each row of pairs and junction: where both orders of a pair's reads fit, the first read at the first
    breakend counts.
    """
    at = lambda k: F.when(F.col(f"fwd{k}"), F.col(f"end{k}")).otherwise(F.col(f"pos{k}"))
    begin = lambda k: F.when(F.col(f"fwd{k}"), at(k)).otherwise(at(k) - F.col("pp_max"))
    end = lambda k: F.when(F.col(f"fwd{k}"), at(k) + F.col("pp_max")).otherwise(at(k)) + 1
    open_ = lambda k: F.when(F.col(f"fwd{k}"), 1).otherwise(2)
    part = lambda k, c: F.when(F.col(f"fwd{k}"), F.col(c) - F.col(f"pos{k}")).otherwise(F.col(f"end{k}") - F.col(c))

    def fits(a: int, b: int):
        own = (F.col(f"tid{a}") == F.col("j_tid")) & intervals.intersects(begin(a), end(a), F.col("j_begin"), F.col("j_end"))
        near = (F.col(f"tid{b}") == F.col("b_tid2")) & F.when(F.col(f"fwd{b}"), (at(b) < F.col("b_end2")) & (at(b) + F.col("pp_max") >= F.col("b_begin2"))).otherwise((at(b) > F.col("b_begin2")) & (at(b) - F.col("pp_max") <= F.col("b_end2")))
        return own & (open_(a) == F.col("b_state1")) & (open_(b) == F.col("b_state2")) & near

    j = found.select(*KEYS, F.col("b_tid1").alias("j_tid"), F.col("b_begin1").alias("j_begin"), F.col("b_end1").alias("j_end"), "b_state1", "b_state2", "b_tid2", "b_begin2", "b_end2", "c1", "c2")
    ends = []
    for a, b in ((1, 2), (2, 1)):
        hit = intervals.overlap_join(pairs.withColumns({"_b": begin(a), "_e": end(a)}), j, left_cols=(f"tid{a}", "_b", "_e"), right_cols=("j_tid", "j_begin", "j_end")).where(fits(a, b))
        hit = hit if a == 1 else hit.where(~F.coalesce(fits(1, 2), F.lit(False)))
        ends.append(hit.select(*KEYS, "sample", "qname", (part(a, "c1") + part(b, "c2")).cast("long").alias("alt_size"), "mapq1", "mapq2"))
    # an imprecise centre may be off by the breakend's width, so a size out of range still counts as the least support
    return with_probability(ends[0].unionByName(ends[1]), shares, "alt_size", "alt_pair").withColumn("alt_pair", F.greatest("alt_pair", F.lit(0.01)))


def ref_pairs(found: DataFrame, pairs: DataFrame, shares: DataFrame, side: int = MIN_SIDE) -> DataFrame:
    """Proper pairs that hold a breakend with at least `side` bases on both sides of it."""
    proper = pairs.where((F.col("tid1") == F.col("tid2")) & F.col("fwd1") & ~F.col("fwd2")).withColumn("ref_size", (F.greatest("end1", "end2") - F.col("pos1")).cast("long"))
    proper = proper.where((F.col("ref_size") >= F.col("pp_min")) & (F.col("ref_size") <= F.col("pp_max"))).withColumns({"_b": F.col("pos1") + side, "_e": F.col("pos1") + F.col("ref_size") - side}).where("_b < _e")
    points = found.select(*KEYS, F.explode(F.array(F.struct(F.col("b_tid1").alias("t"), F.col("c1").alias("c")), F.struct(F.col("b_tid2").alias("t"), F.col("c2").alias("c")))).alias("p"))
    points = points.select(*KEYS, F.col("p.t").alias("p_tid"), F.col("p.c").alias("p_begin"), (F.col("p.c") + 1).alias("p_end"))
    hit = intervals.overlap_join(proper, points, left_cols=("tid1", "_b", "_e"), right_cols=("p_tid", "p_begin", "p_end"))
    one = hit.select(*KEYS, "sample", "qname", "ref_size", "mapq1", "mapq2").distinct()
    return with_probability(one, shares, "ref_size", "ref_pair")


def evidence(calls: DataFrame, ready: DataFrame, histogram: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """The evidence table of candidates (with event and kind) from reads; pair evidence only, as imprecise junctions have no sequence."""
    found, pairs, shares = junctions(calls), fragments(ready), size_shares(histogram)
    alt, ref = alt_pairs(found, pairs, shares), ref_pairs(found, pairs, shares)
    rows = alt.select(*KEYS, "sample", "qname", "mapq1", "mapq2", "alt_pair", F.lit(None).cast("double").alias("ref_pair")).unionByName(ref.select(*KEYS, "sample", "qname", "mapq1", "mapq2", F.lit(None).cast("double").alias("alt_pair"), "ref_pair"))
    one = rows.groupBy(*KEYS, "sample", "qname").agg(*[F.max(x).alias(x) for x in ("mapq1", "mapq2", "alt_pair", "ref_pair")])
    # what supports one allele is weighed against the other at zero
    one = one.where((F.coalesce("alt_pair", F.lit(0.0)) >= MIN_PROBABILITY) | (F.coalesce("ref_pair", F.lit(0.0)) >= MIN_PROBABILITY))
    flags = {}
    for k in (1, 2):
        flags |= {f"r{k}_scanned": F.lit(True), f"r{k}_anchored": F.col(f"mapq{k}") >= options.min_mapq, f"r{k}_anchored2": F.col(f"mapq{k}") >= options.min_tier2_mapq, f"r{k}_split": F.lit(False), f"r{k}_split2": F.lit(False), f"r{k}_ref_lnl": F.lit(0.0), f"r{k}_alt_lnl": F.lit(0.0)}
    counted = found.groupBy("event").agg(F.count("*").cast("int").alias("junctions"))
    # an imprecise event has no known insertion, so an innie pair of breakends is a deletion; small ones are not told by pairs
    kind = F.when(F.col("kind") == "INDEL", "DELETE").otherwise(F.col("kind"))
    weight = scoring.pair_weight(F.col("size"), kind).cast("double").alias("pair_weight")
    return one.withColumns(flags).join(found.select(*KEYS, "size", "same_contig", weight), KEYS).join(counted, "event").withColumn("imprecise", F.lit(True))


def split_reads(found: DataFrame, reads: DataFrame, alleles: DataFrame, reach: int = 200, edge: int = 100) -> DataFrame:
    """Split alignments of the reads near precise junctions: lnl and evidence of each read for each allele and breakend.

    alleles has event, junction, allele (ref or alt), bp, target (bases), begin and end (the breakpoint range in it);
    junctions within `edge` of a contig's ends have none.
    """
    points = found.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("bp"), F.col(f"b_tid{k}").alias("t"), F.col(f"b_begin{k}").alias("b"), F.col(f"b_end{k}").alias("e")) for k in (1, 2)])).alias("p"))
    points = points.select(*KEYS, F.col("p.bp").alias("bp"), F.col("p.t").alias("p_tid"), (F.col("p.b") - reach).alias("p_begin"), (F.col("p.e") + reach).alias("p_end")).where(F.col("p_begin") + reach >= edge)
    near = intervals.overlap_join(reads.withColumn("_end", F.col("pos0") + F.length("seq")), points, left_cols=("tid", "pos0", "_end"), right_cols=("p_tid", "p_begin", "p_end"))
    one = near.select(*KEYS, "bp", "sample", "qname", F.when(F.col("is_second"), 2).otherwise(1).alias("read_no"), "seq", "qual").dropDuplicates([*KEYS, "bp", "sample", "qname", "read_no"])
    rows = one.join(alleles, [*KEYS, "bp"]).where(F.length("seq") < F.length("target"))
    return rows.withColumn("_s", align.split_read_columns("seq", "qual", "target", "begin", "end")).select(*KEYS, "bp", "sample", "qname", "read_no", "allele", "_s.lnl", "_s.evidence", "_s.evidence2")


def add_splits(evidence_: DataFrame, splits: DataFrame) -> DataFrame:
    """The evidence table with the split reads' log likelihoods: of the two breakends the better one counts."""
    best = splits.groupBy(*KEYS, "sample", "qname", "read_no").agg(
        *[F.max(F.when(F.col("allele") == a, F.col("lnl"))).alias(f"{a}_lnl") for a in ("ref", "alt")], F.bool_or("evidence").alias("split"), F.bool_or("evidence2").alias("split2")
    )
    fields = ("ref_lnl", "alt_lnl", "split", "split2")
    wide = best.groupBy(*KEYS, "sample", "qname").agg(*[F.max(F.when(F.col("read_no") == k, F.col(f))).alias(f"_r{k}_{f}") for k in (1, 2) for f in fields])
    # a fragment seen by its split reads alone takes what belongs to its junction from the others
    shared = ["size", "same_contig", "junctions", "pair_weight", "imprecise"]
    of_junction = evidence_.groupBy(*KEYS).agg(*[F.max(c).alias(f"_{c}") for c in shared])
    out = evidence_.join(wide, [*KEYS, "sample", "qname"], "full_outer").join(of_junction, KEYS)
    out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in shared})
    seen = {f"r{k}_{x}": F.coalesce(f"r{k}_{x}", F.lit(True)) for k in (1, 2) for x in ("scanned", "anchored", "anchored2")}
    default = {"ref_lnl": F.lit(0.0), "alt_lnl": F.lit(0.0), "split": F.lit(False), "split2": F.lit(False)}
    lnl = {f"r{k}_{f}": F.coalesce(f"_r{k}_{f}", f"r{k}_{f}", default[f]) for k in (1, 2) for f in fields}
    return out.withColumns(seen | lnl).select(*evidence_.columns)


def remote_reads(reads: DataFrame, anchors: DataFrame, pad: int = 500) -> DataFrame:
    """Mates of anchor reads (sample, qname, read_no, mate_tid, mate_pos0), of mapping quality 0, fetched over their merged regions."""
    regions = anchors.select(F.col("mate_tid").alias("tid"), F.greatest(F.lit(0), F.col("mate_pos0") - pad).alias("begin"), (F.col("mate_pos0") + pad).alias("end"))
    merged = intervals.merged(regions).select(F.col("tid").alias("m_tid"), F.col("begin").alias("m_begin"), F.col("end").alias("m_end"))
    wanted = anchors.select("sample", "qname", (3 - F.col("read_no")).alias("read_no"))
    own = reads.withColumns({"read_no": F.when(F.col("is_second"), 2).otherwise(1), "_end": F.col("pos0") + 1}).where("mapq = 0")
    inside = intervals.overlap_join(own, merged, left_cols=("tid", "pos0", "_end"), right_cols=("m_tid", "m_begin", "m_end")).drop("m_tid", "m_begin", "m_end", "_end")
    return inside.join(wanted, ["sample", "qname", "read_no"], "left_semi")


def edge_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of edges whose two ends both overlap: a and b have id, t1, b1, e1, t2, b2, e2."""
    right = b.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "t1", "b1", "e1", "t2", "b2", "e2")])
    hit = intervals.overlap_join(a, right, left_cols=("t1", "b1", "e1"), right_cols=("o_t1", "o_b1", "o_e1"))
    return hit.where((F.col("t2") == F.col("o_t2")) & intervals.intersects(F.col("b2"), F.col("e2"), F.col("o_b2"), F.col("o_e2"))).select("id", "o_id")


def edge_statistics(log: DataFrame) -> DataFrame:
    """Sums of each kind of edge from a log of edges (kind, candidates, assembled, scored, seconds)."""
    return log.groupBy("kind").agg(F.count("*").alias("edges"), *[F.sum(c).alias(c) for c in ("candidates", "assembled", "scored")], F.sum("seconds").alias("seconds"))


def slow_edges(log: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges that took at least `least` seconds, the slowest first."""
    return log.where(F.col("seconds") >= least).orderBy(F.col("seconds").desc())

