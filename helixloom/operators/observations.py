"""Observations: each read's evidence as pairs of oriented breakend intervals, all by column expressions.

An observation has bp1 (local) and bp2 (remote), each with state, tid, begin and end, an evidence type, and the
weights that it adds to the breakend graph in each direction. Only the semi-aligned scan compares bases and is
an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.prob import ramp
from ..schema import COMPLEX, LEFT_OPEN, RIGHT_OPEN, UNKNOWN
from . import reads as R

WEIGHT, CLOSE_WEIGHT = 3, 1
COLUMNS = ["sample", "qname", "read_no", "ev_type", "bp1_state", "bp1_tid", "bp1_begin", "bp1_end", "bp2_state", "bp2_tid", "bp2_begin", "bp2_end", "w_local", "w_remote", "r1_tid", "r1_pos", "r2_tid", "r2_pos"]


def window(pos: Column, length: Column, size: int = 40) -> tuple[Column, Column]:
    """The breakend interval about a place, clipped to the contig."""
    before = size // 2
    return F.greatest(F.lit(0), pos - before), F.least(length, pos + (size - before))


def _base(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    own = contigs.select("tid", F.col("length").alias("_length"))
    return reads.join(F.broadcast(own), "tid").withColumn("read_no", F.when(F.col("is_second"), 2).otherwise(1))


def _rows(df: DataFrame, ev_type: str, **columns) -> DataFrame:
    # where the reads start that speak for each breakend: this one for both, but for pairs
    second = ("mate_tid", "mate_pos0") if ev_type == "LOCAL_PAIR" else ("tid", "pos0")
    reads = {"r1_tid": F.col("tid"), "r1_pos": F.col("pos0"), "r2_tid": F.col(second[0]), "r2_pos": F.col(second[1])}
    out = df.withColumns({"ev_type": F.lit(ev_type), **columns, **reads})
    return out.select(*COLUMNS)


def from_indels(reads: DataFrame, contigs: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """Large insertions and deletions. Insertions at a read's edge have one complex breakend; neighbours I and D are one swap."""
    path = F.col("path")
    matched = F.transform(path, lambda s: s["op"].isin(*cigar.MATCH))
    sides = cigar.once(matched, lambda m: F.struct((F.array_position(m, True) - 1).alias("first"), (F.size(m) - F.array_position(F.reverse(m), True)).alias("last")))
    indel = lambda s: F.coalesce(s["op"].isin("I", "D"), F.lit(False))

    # a run of I and D is told by its first operation, with the summed lengths of both kinds
    def heads(x: Column) -> Column:
        starts = x["starts"]
        firsts = F.filter(starts, lambda s, i: indel(s) & ~indel(F.get(starts, i - 1)))
        places = F.filter(F.transform(starts, lambda s, i: F.when(indel(s) & ~indel(F.get(starts, i - 1)), i)), lambda i: i.isNotNull())
        return F.zip_with(
            firsts,
            places,
            lambda s, i: F.struct(
                s["op"].alias("op"),
                s["ref"].alias("ref"),
                ((i < x["sides"]["first"]) | (i > x["sides"]["last"])).alias("edge"),
                F.when(s["op"] == "D", s["len"]).otherwise(0).alias("d"),
                F.when(s["op"] == "I", s["len"]).otherwise(0).alias("i"),
                F.when(indel(F.get(starts, i + 1)), F.get(starts, i + 1)["op"]).alias("next_op"),
                F.coalesce(F.get(starts, i + 1)["len"], F.lit(0)).alias("next_len"),
            ),
        )

    steps = cigar.once(F.struct(cigar.with_starts(path).alias("starts"), sides.alias("sides")), heads)
    # tested where the steps are made: as a filter it would go below the parsing of the path and parse it again
    df = _base(reads, contigs).select("*", F.explode(F.when(R.local_indel(options.min_candidate_size), steps)).alias("_s"))
    d = F.col("_s.d") + F.when(F.col("_s.next_op") == "D", F.col("_s.next_len")).otherwise(0)
    i = F.col("_s.i") + F.when(F.col("_s.next_op") == "I", F.col("_s.next_len")).otherwise(0)
    df = df.withColumns({"_d": d, "_i": i, "_left": F.col("pos0") + F.col("_s.ref")})
    least = options.min_candidate_size
    df = df.where(F.when(F.col("_s.edge"), F.col("_s.i") >= least).otherwise((F.col("_d") >= least) | (F.col("_i") >= least)))
    right = F.when(F.col("_s.edge"), F.col("_left")).otherwise(F.col("_left") + F.col("_d"))
    b1, e1 = window(F.col("_left"), F.col("_length"), options.breakend_size)
    b2, e2 = window(right, F.col("_length"), options.breakend_size)
    edge = F.col("_s.edge")
    return _rows(
        df, "CIGAR", bp1_state=F.when(edge, COMPLEX).otherwise(RIGHT_OPEN), bp1_tid=F.col("tid"), bp1_begin=b1, bp1_end=e1,
        bp2_state=F.when(edge, UNKNOWN).otherwise(LEFT_OPEN), bp2_tid=F.col("tid"), bp2_begin=b2, bp2_end=e2, w_local=F.lit(WEIGHT), w_remote=F.when(edge, 0).otherwise(WEIGHT),
    )


def split_segments(sa: Column) -> Column:
    """array<struct<chrom,pos0,strand,cigar,mapq>> of a split tag; a malformed segment raises."""
    parts = F.transform(F.filter(F.split(sa, ";"), lambda x: x != ""), lambda x: F.split(x, ","))
    bad = lambda f: F.raise_error(F.concat(F.lit("Unexpected format in the split alignment segment: "), F.array_join(f, ",")))
    ok = lambda f: (F.size(f) == 6) & F.get(f, 2).isin("+", "-")
    checked = F.transform(parts, lambda f: F.when(ok(f), f).otherwise(bad(f).cast("array<string>")))
    part = lambda f, k: F.get(f, k)
    return F.transform(checked, lambda f: F.struct(part(f, 0).alias("chrom"), (part(f, 1).cast("int") - 1).alias("pos0"), part(f, 2).alias("strand"), part(f, 3).alias("cigar"), part(f, 4).cast("int").alias("mapq")))


def from_splits(reads: DataFrame, contigs: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """Reads with just one split segment of enough quality; the evidence is local only."""
    # one row for a read with one segment, none for others; a filter would go below and take the tag apart again
    single = cigar.once(split_segments(F.col("sa")), lambda x: F.when(F.size(x) == 1, x))
    df = _base(reads.where("is_split"), contigs).select("*", F.explode(single).alias("_sa"))
    df = df.where(F.col("_sa.mapq") >= options.min_mapq)
    other = contigs.select(F.col("label").alias("_chrom"), F.col("tid").alias("_rtid"), F.col("length").alias("_rlength"))
    df = df.join(F.broadcast(other), F.col("_sa.chrom") == F.col("_chrom"), "left")
    df = df.withColumn("_rtid", F.coalesce("_rtid", F.raise_error(F.concat(F.lit("Split alignment segment maps to an unknown chromosome: "), F.col("_sa.chrom"))).cast("int"))).withColumn("_rpath", cigar.parse(F.col("_sa.cigar")))

    downstream = lambda path: cigar.clip_lead(path) < cigar.clip_trail(path)
    df = df.withColumns({"_down1": downstream(F.col("path")), "_down2": downstream(F.col("_rpath"))})
    df = df.withColumns({f"_at{k}": F.when(F.col(f"_down{k}"), F.col(pos) + cigar.ref_length(F.col(path))).otherwise(F.col(pos)) for k, pos, path in ((1, "pos0", "path"), (2, "_sa.pos0", "_rpath"))})
    state = lambda k: F.when(F.col(f"_down{k}"), RIGHT_OPEN).otherwise(LEFT_OPEN)
    (b1, e1), (b2, e2) = (window(F.col(f"_at{k}"), F.col(length), options.breakend_size) for k, length in ((1, "_length"), (2, "_rlength")))
    return _rows(df, "SPLIT_ALIGN", bp1_state=state(1), bp1_tid=F.col("tid"), bp1_begin=b1, bp1_end=e1, bp2_state=state(2), bp2_tid=F.col("_rtid"), bp2_begin=b2, bp2_end=e2, w_local=F.lit(WEIGHT), w_remote=F.lit(0))


def transcript_strand(first: Column, fwd: Column, path: Column) -> Column:
    """Whether a split read of a stranded transcript assay speaks for the forward strand."""
    return (first == fwd) == (cigar.clip_lead(path) < cigar.clip_trail(path))


def from_pairs(reads: DataFrame, contigs: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """Anomalous pairs. Breakends reach as far from the reads as the sample's fragment sizes allow.

    The scale is 1 for other contigs, equal strands and outties, -1 (dropped) for normal pairs, and rises from 0 to
    1 over the sample's large sizes for long ones. Pairs at a contig's end are dropped. Needs the limits of reads.sample_limits.
    """
    mate = R.mate_path()
    inner = lambda fwd, path: F.when(fwd, cigar.unaligned_suffix(path)).otherwise(cigar.unaligned_prefix(path))
    other = contigs.select(F.col("tid").alias("mate_tid"), F.col("length").alias("_rlength"))
    df = _base(reads.where(R.mapped_pair() & R.non_compressed_anomalous() & ~F.col("is_non_strict_supplement")), contigs).join(F.broadcast(other), "mate_tid").withColumn("_mate", mate)
    df = df.withColumns(
        {
            "_solid": (cigar.read_length(F.col("path")) - inner(F.col("is_fwd"), F.col("path"))) + (cigar.read_length(F.col("_mate")) - inner(F.col("is_mate_fwd"), F.col("_mate"))),
            "_end": F.col("pos0") + cigar.ref_length(F.col("path")),
            "_rend": F.col("mate_pos0") + cigar.ref_length(F.col("_mate")),
        }
    )
    gap = F.when(F.col("is_fwd"), F.col("mate_pos0") - F.col("_end")).otherwise(F.col("pos0") - F.col("_rend"))
    size = F.col("_solid") + gap
    large = size > F.col("pp_max") + options.min_candidate_size
    slope = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (size - F.col("large_low")) / (F.col("large_high") - F.col("large_low"))))
    scale = F.when((F.col("tid") != F.col("mate_tid")) | (F.col("is_fwd") == F.col("is_mate_fwd")) | (size < 0), F.lit(1.0)).when(large, slope).otherwise(F.lit(-1.0))
    df = df.withColumn("_scale", scale).where("_scale >= 0")
    at_end = lambda fwd, end, length, pos: F.when(fwd, end >= length).otherwise(pos <= 0)
    df = df.where(~at_end(F.col("is_fwd"), F.col("_end"), F.col("_length"), F.col("pos0")) & ~at_end(F.col("is_mate_fwd"), F.col("_rend"), F.col("_rlength"), F.col("mate_pos0")))
    reach = F.greatest(F.lit(options.breakend_size), F.floor(F.col("_scale") * F.col("pp_max") + (1 - F.col("_scale")) * F.col("be_max") - F.col("_solid")).cast("int"))
    df = df.withColumn("_reach", reach)

    def side(fwd: Column, pos: Column, end: Column, length: Column):
        begin = F.when(fwd, F.least(length, end)).otherwise(F.greatest(F.lit(0), pos - F.col("_reach")))
        stop = F.when(fwd, F.least(length, end + F.col("_reach"))).otherwise(pos)
        return F.when(fwd, RIGHT_OPEN).otherwise(LEFT_OPEN), begin, stop

    s1, b1, e1 = side(F.col("is_fwd"), F.col("pos0"), F.col("_end"), F.col("_length"))
    s2, b2, e2 = side(F.col("is_mate_fwd"), F.col("mate_pos0"), F.col("_rend"), F.col("_rlength"))
    weight = F.when(R.innie() & (F.abs("tlen") < F.col("pp_max") * 4), CLOSE_WEIGHT).otherwise(WEIGHT)
    # without the mate's own record only the local side has evidence
    return _rows(df, "LOCAL_PAIR", bp1_state=s1, bp1_tid=F.col("tid"), bp1_begin=b1, bp1_end=e1, bp2_state=s2, bp2_tid=F.col("mate_tid"), bp2_begin=b2, bp2_end=e2, w_local=weight, w_remote=F.lit(0))


def edge_lengths(seq: str, ops: list[tuple[str, int]], pos: int, ref: str, offset: int, run: int = 5) -> tuple[int, int, int, int]:
    """Lengths of the poorly aligned edges of a read (its clips as matches) and the reference places where they end.

    An edge ends before the first `run` successive bases that match; N matches all.
    """

    def scan(ops, seq, at):
        read, here, streak = 0, at, 0
        for op, n in ops:
            if op in "M=X":
                for k in range(n):
                    r = here + k - offset
                    a, b = seq[read + k], ref[r] if 0 <= r < len(ref) else "N"
                    streak = streak + 1 if a == b or a == "N" or b == "N" else 0
                    if streak >= run:
                        return read + k - streak + 1, here + k - streak + 1
            elif op in "ID":
                streak = 0
            read += n if op in "MIS=X" else 0
            here += n if op in "MDN=X" else 0
        return read, here

    lead = ops[0][1] if ops and ops[0][0] == "S" else (ops[1][1] if len(ops) > 1 and ops[0][0] == "H" and ops[1][0] == "S" else 0)
    matched = [("M" if op == "S" else op, n) for op, n in ops if op != "H"]
    start = pos - lead
    span = sum(n for op, n in matched if op in "MDN=X")
    lead_n, lead_at = scan(matched, seq, start)
    # the mirror image: places run backwards from the last base
    end = start + span
    mirror_offset = -(offset + len(ref) - 1)
    back_ref = ref[::-1]

    def scan_back():
        read, here, streak = 0, -(end - 1), 0
        for op, n in reversed(matched):
            if op in "M=X":
                for k in range(n):
                    r = here + k - mirror_offset
                    a, b = seq[len(seq) - 1 - read - k], back_ref[r] if 0 <= r < len(back_ref) else "N"
                    streak = streak + 1 if a == b or a == "N" or b == "N" else 0
                    if streak >= run:
                        return read + k - streak + 1, -(here + k) + streak
            elif op in "ID":
                streak = 0
            read += n if op in "MIS=X" else 0
            here += n if op in "MDN=X" else 0
        return read, -here + 1

    trail_n, trail_at = scan_back()
    return lead_n, lead_at, trail_n, trail_at


def with_edges(reads: DataFrame, reference: DataFrame, min_quality: int = 20, share: float = 0.75) -> DataFrame:
    """Adds lead_n, lead_at, trail_n and trail_at: poorly aligned edges of good base quality (0 if none).

    reference has tid, offset and bases of the contig about each read (join by tid); interior edges of
    overlapping pairs do not count, nor do reads that are poorly aligned as a whole.
    """

    @F.pandas_udf("lead_n int, lead_at int, trail_n int, trail_at int")
    def scan(seq: pd.Series, ops: pd.Series, pos: pd.Series, qual: pd.Series, ref: pd.Series, offset: pd.Series, overlapping: pd.Series, fwd: pd.Series, split: pd.Series) -> pd.DataFrame:
        out = []
        for s, path, p, q, r, o, over, f, sp in zip(seq, ops, pos, qual, ref, offset, overlapping, fwd, split):
            a, a_at, b, b_at = edge_lengths(s, [(x["op"], int(x["len"])) for x in path], int(p), r, int(o))
            if a + b >= len(s):
                a = b = 0
            q = np.asarray(q)
            good = lambda part: len(part) and (part >= min_quality).mean() >= share
            if a and not ((not over or sp or f) and good(q[:a])):
                a = 0
            if b and not ((not over or sp or not f) and good(q[len(q) - b :])):
                b = 0
            out.append((a, a_at, b, b_at))
        return pd.DataFrame(out, columns=["lead_n", "lead_at", "trail_n", "trail_at"])

    joined = reads.join(F.broadcast(reference.select("tid", F.col("offset").alias("_offset"), F.col("bases").alias("_bases"))), "tid")
    over = F.coalesce(R.overlapping_pair(), F.lit(False))
    edges = scan("seq", "path", "pos0", "qual", "_bases", "_offset", over, "is_fwd", "is_split")
    return joined.withColumn("_e", edges).select(*reads.columns, "_e.*")


def from_edges(reads: DataFrame, contigs: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """Up to two complex breakends of semi-aligned reads (columns of with_edges)."""
    least = options.min_semi_aligned
    places = F.filter(F.array(F.when(F.col("lead_n") >= least, F.col("lead_at")), F.when(F.col("trail_n") >= least, F.col("trail_at"))), lambda x: x.isNotNull())
    df = _base(reads.where(~F.col("is_split") & ((F.col("lead_n") >= least) | (F.col("trail_n") >= least))), contigs).select("*", F.explode(places).alias("_at"))
    b, e = window(F.col("_at"), F.col("_length"), options.breakend_size)
    return _rows(df, "SEMIALIGN", bp1_state=F.lit(COMPLEX), bp1_tid=F.col("tid"), bp1_begin=b, bp1_end=e, bp2_state=F.lit(UNKNOWN), bp2_tid=F.col("tid"), bp2_begin=b, bp2_end=e, w_local=F.lit(WEIGHT), w_remote=F.lit(0))


def observations(reads: DataFrame, contigs: DataFrame, options: R.Options = R.Options()) -> DataFrame:
    """All observations of reads (with_flags, limits joined) that have enough mapping quality."""
    use = reads.where(~R.mapped_filtered() & (F.col("mapq") >= options.min_mapq))
    out = from_indels(use, contigs, options).unionByName(from_splits(use, contigs, options)).unionByName(from_pairs(use, contigs, options))
    if "lead_n" in reads.columns:
        out = out.unionByName(from_edges(use, contigs, options))
    return out


def fragments(found: DataFrame) -> DataFrame:
    """Observations of both mates of a fragment as one pair observation with evidence on both sides, where they agree."""
    pairs = found.where("ev_type = 'LOCAL_PAIR'")
    a, b = pairs.where("read_no = 1"), pairs.where("read_no = 2")
    b = b.select("sample", "qname", *[F.col(c).alias(f"_{c}") for c in COLUMNS if c.startswith(("bp", "w_"))])
    meet = lambda x, y: (F.col(f"{x}_tid") == F.col(f"_{y}_tid")) & (F.col(f"{x}_state") == F.col(f"_{y}_state")) & (F.col(f"{x}_begin") < F.col(f"_{y}_end")) & (F.col(f"_{y}_begin") < F.col(f"{x}_end"))
    both = a.join(b, ["sample", "qname"]).where(meet("bp1", "bp2") & meet("bp2", "bp1")).withColumn("ev_type", F.lit("PAIR")).withColumn("w_remote", F.col("_w_local"))
    one = both.select(*COLUMNS)
    rest = pairs.join(one.select("sample", "qname"), ["sample", "qname"], "left_anti")
    return one.unionByName(rest.select(*COLUMNS)).unionByName(found.where("ev_type <> 'LOCAL_PAIR'").select(*COLUMNS))


def collapsed_near_indels(found: DataFrame, pad: int = 30) -> DataFrame:
    """Indel-like observations whose padded breakends meet become complex."""
    near = (F.col("bp1_tid") == F.col("bp2_tid")) & (F.col("bp1_state") == RIGHT_OPEN) & (F.col("bp2_state") == LEFT_OPEN) & (F.col("bp1_begin") - pad < F.col("bp2_end") + pad) & (F.col("bp2_begin") - pad < F.col("bp1_end") + pad)
    hull_b, hull_e = F.least("bp1_begin", "bp2_begin"), F.greatest("bp1_end", "bp2_end")
    return found.withColumn("_near", near).select(*[
        {"bp1_state": F.when(F.col("_near"), COMPLEX).otherwise(F.col(c)), "bp2_state": F.when(F.col("_near"), UNKNOWN).otherwise(F.col(c)),
         "bp1_begin": F.when(F.col("_near"), hull_b).otherwise(F.col(c)), "bp1_end": F.when(F.col("_near"), hull_e).otherwise(F.col(c))}.get(c, F.col(c)).alias(c) for c in found.columns
    ])


def proto_edges(found: DataFrame) -> DataFrame:
    """Two directed node-to-node rows for each spanning observation, one self edge for each complex one.

    A node that overlaps its partner is merged with it into a self edge.
    """
    complex_ = F.col("bp1_state") == COMPLEX
    meet = ~complex_ & (F.col("bp1_tid") == F.col("bp2_tid")) & (F.col("bp1_begin") < F.col("bp2_end")) & (F.col("bp2_begin") < F.col("bp1_end"))
    node = lambda k: F.struct(F.col(f"bp{k}_tid").alias("tid"), F.col(f"bp{k}_begin").alias("begin"), F.col(f"bp{k}_end").alias("end"))
    hull = F.struct(F.col("bp1_tid").alias("tid"), F.least("bp1_begin", "bp2_begin").alias("begin"), F.greatest("bp1_end", "bp2_end").alias("end"))
    edge = lambda a, b, w: F.struct(a.alias("a"), b.alias("b"), w.cast("long").alias("w"))
    rows = (
        F.when(complex_, F.array(edge(node(1), node(1), F.col("w_local"))))
        .when(meet, F.array(edge(hull, hull, F.greatest("w_local", "w_remote"))))
        .otherwise(F.array(edge(node(1), node(2), F.col("w_local")), edge(node(2), node(1), F.col("w_remote"))))
    )
    return found.select("sample", "qname", F.explode(rows).alias("_e")).select("sample", "qname", "_e.a", "_e.b", "_e.w")


def scaled(x: Column, low: float, high: float) -> Column:
    return ramp(x, low, high)
