"""Scoring models: germline, somatic, tumour-only and RNA.

The evidence table has one row for each fragment of each junction in each sample:

  event, junction, sample, qname: an event is one or two junctions that are judged together
  r1_scanned, r2_scanned, r1_anchored, r2_anchored, r1_anchored2, r2_anchored2: what was seen of each read; 2 is the permissive tier
  ref_pair, alt_pair: fragment-size probability under each allele, null without pair support
  r1_split, r2_split (and r1_split2, r2_split2): whether the read's split alignment counts
  r1_ref_lnl, r1_alt_lnl, r2_ref_lnl, r2_alt_lnl: log likelihoods of the split alignments

All models are sums over fragments of column expressions, so evidence is aggregated before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prob

MAX_Q = 999
SPLIT_SUPPORT, PAIR_SUPPORT = 0.999, 0.9
GENOTYPES = ("REF", "HET", "HOM")
ALT_FRACTION = (0.0, 0.5, 0.99)
INDEL_PRIOR = 1e-5
DIPLOID_PRIOR = (1 - 1.5 * INDEL_PRIOR, INDEL_PRIOR, INDEL_PRIOR / 2)
SOMATIC_STATES = ("REF", "HET", "HOM", "SOM", "NOISE")
GERMLINE_PRIOR, SOMATIC_PRIOR, SMALL_NOISE_PRIOR, LARGE_NOISE_PRIOR = 1e-5, 1e-7, 1e-9, 1e-10
MIN_QUAL, MIN_GQ, MIN_SOMATIC, MAX_MQ0, MQ0_SIZE, LOCAL_SIZE = 20, 15, 30, 0.4, 1000, 100_000
RNA_SCORE = 42


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def fragment_probability(size: Column, share_below: Column) -> Column:
    """How likely a fragment is at least as odd as this: the CDF, folded at the middle."""
    return F.least(share_below, 1 - share_below)


def pair_support(evidence: DataFrame, least: float = 1e-4) -> DataFrame:
    """Pair probabilities below the least as no support."""
    cut = lambda c: F.when(F.col(c) >= least, F.col(c)).alias(c)
    return evidence.select(*[cut(c) if c in ("ref_pair", "alt_pair") else F.col(c) for c in evidence.columns])


def resolved_conflicts(evidence: DataFrame, size: str = "size", imprecise: str = "imprecise", most: int = 1000) -> DataFrame:
    """Pair support goes where a split read of the fragment clearly says otherwise: support for alt only for small precise events."""
    ref, alt = _zero("ref_pair") > _zero("alt_pair"), _zero("alt_pair") > _zero("ref_pair")
    against = lambda r: F.col(f"{r}_split") & ((ref & (F.col(f"{r}_alt_lnl") > F.col(f"{r}_ref_lnl"))) | (alt & (F.col(size) <= most) & (F.col(f"{r}_ref_lnl") > F.col(f"{r}_alt_lnl"))))
    clear = ~F.col(imprecise) & F.coalesce(against("r1") | against("r2"), F.lit(False))
    return evidence.select(*[F.when(~clear, F.col(c)).alias(c) if c in ("ref_pair", "alt_pair") else F.col(c) for c in evidence.columns])


def support_counts(evidence: DataFrame, keys=("event", "junction", "sample")) -> DataFrame:
    """Confident split reads, spanning pairs and confident spanning pairs of both alleles."""
    share = lambda r, a, b: 1 / (1 + F.exp(F.col(f"{r}_{b}_lnl") - F.col(f"{r}_{a}_lnl")))
    split = lambda r, a, b: F.coalesce((F.col(f"{r}_split") & (share(r, a, b) > SPLIT_SUPPORT)).cast("long"), F.lit(0))
    both = _zero("ref_pair") + _zero("alt_pair")
    confident = lambda a, b: (both > 0) & (_zero(f"{a}_pair") >= _zero(f"{b}_pair")) & (_zero(f"{a}_pair") / F.when(both > 0, both) > PAIR_SUPPORT)
    full = F.col("r1_scanned") & F.col("r2_scanned") & F.col("r1_anchored") & F.col("r2_anchored")
    aggs = []
    for a, b in (("ref", "alt"), ("alt", "ref")):
        aggs += [
            F.sum(split("r1", a, b) + split("r2", a, b)).alias(f"{a}_split"),
            F.count(f"{a}_pair").alias(f"{a}_spanning"),
            F.count_if(confident(a, b)).alias(f"{a}_semi_mapped"),
            F.count_if(confident(a, b) & full).alias(f"{a}_confident_spanning"),
        ]
    return evidence.groupBy(*keys).agg(*aggs)


def pair_weight(size: Column, kind: Column, large_insert: Column | None = None, insert_size: Column | None = None) -> Column:
    """How far pairs count: small deletions and insertions cannot be told by them."""
    out = F.when(kind.isin("INSERT", "DELETE"), prob.ramp(size, 300, 500)).otherwise(F.lit(1.0))
    if large_insert is not None:
        out = F.when((kind == "INSERT") & large_insert, prob.ramp(insert_size, 100, 150)).otherwise(out)
    return out


def large_noise_weight(size: Column, same_contig: Column) -> Column:
    return F.when(same_contig, prob.ramp(size, 5000, 10_000)).otherwise(F.lit(1.0))


def fragment_likelihoods(
    evidence: DataFrame, weight: str = "pair_weight", ref_chimera: float = 1e-3, alt_chimera: float = 1e-3, ref_map: float = 1e-6, alt_map: float = 1e-5, permissive: bool = False, semi_mapped_power: float = 0.0
) -> DataFrame:
    """Fragments that say something, with ref_ln and alt_ln: their log likelihoods under each allele.

    A pair is a mixture with chimeras, to the power of its weight; a split read a mixture with wrong mapping. Of
    two split reads the better one counts. Split reads that noise explains as well add nothing.
    """
    tier = "2" if permissive else ""
    anchored = [F.col(f"r{k}_anchored{tier}") for k in (1, 2)]
    scanned = [F.col(f"r{k}_scanned") for k in (1, 2)]
    usable = ((scanned[0] & anchored[0]) | (scanned[1] & anchored[1])) if permissive else (scanned[0] & scanned[1] & (anchored[0] | anchored[1]))
    supported = F.col("ref_pair").isNotNull() | F.col("alt_pair").isNotNull()
    has_pair = F.coalesce(usable & supported, F.lit(False))
    semi = ~(anchored[0] & anchored[1])
    power = F.when(semi, F.when(_zero("alt_pair") > _zero("ref_pair"), F.col(weight) * semi_mapped_power).otherwise(F.lit(0.0))).otherwise(F.col(weight))
    pair = lambda c, own, other: F.when(has_pair, F.log((1 - own) * _zero(c) + other) * power).otherwise(F.lit(0.0))
    out = evidence.withColumns({"_pair": has_pair, "_ref_pair": pair("ref_pair", ref_chimera, alt_chimera), "_alt_pair": pair("alt_pair", alt_chimera, ref_chimera)})
    for r in ("r1", "r2"):
        use = F.coalesce(F.col(f"{r}_split{tier}"), F.lit(False))
        ref = prob.log_sum2(F.lit(math.log1p(-ref_map)) + F.col(f"{r}_ref_lnl"), F.lit(math.log(alt_map)))
        alt = prob.log_sum2(F.lit(math.log1p(-alt_map)) + F.col(f"{r}_alt_lnl"), F.lit(math.log(ref_map)))
        noise = (ref < math.log(alt_map) + 0.5) & (alt < math.log(ref_map) + 0.5)
        out = out.withColumns({f"_{r}": use, f"_{r}_ref": F.when(use & ~noise, ref).otherwise(F.lit(0.0)), f"_{r}_alt": F.when(use & ~noise, alt).otherwise(F.lit(0.0))})
    split = lambda a: F.when(F.col("_r1") & F.col("_r2"), F.greatest(f"_r1_{a}", f"_r2_{a}")).when(F.col("_r1"), F.col(f"_r1_{a}")).when(F.col("_r2"), F.col(f"_r2_{a}")).otherwise(F.lit(0.0))
    out = out.where("_pair OR _r1 OR _r2").withColumns({"ref_ln": F.col("_ref_pair") + split("ref"), "alt_ln": F.col("_alt_pair") + split("alt")})
    return out.select(*evidence.columns, "ref_ln", "alt_ln")


def _mixture(fraction: Column) -> Column:
    """log((1 - f) exp(ref) + f exp(alt))."""
    top = F.greatest("ref_ln", "alt_ln")
    mixed = (1 - fraction) * F.exp(F.col("ref_ln") - top) + fraction * F.exp(F.col("alt_ln") - top)
    return top + F.log(F.greatest(mixed, F.lit(1e-300)))


def diploid(evidence: DataFrame, keys=("event",), sample: str = "sample") -> DataFrame:
    """gt, gq, pl and probabilities of each genotype of each event in each sample."""
    terms = fragment_likelihoods(evidence)
    sums = terms.groupBy(*keys, sample).agg(*[F.sum(_mixture(F.lit(f))).alias(f"_l{k}") for k, f in enumerate(ALT_FRACTION)])
    # events without a fragment that says anything keep the prior
    base = evidence.select(*keys, sample).distinct().join(sums, [*keys, sample], "left").fillna(0.0, [f"_l{k}" for k in range(3)])
    logs = F.array(*[F.col(f"_l{k}") for k in range(3)])
    out = base.withColumn("_p", prob.normalised(F.transform(F.arrays_zip(logs.alias("l"), F.array(*[F.lit(math.log(p)) for p in DIPLOID_PRIOR]).alias("p")), lambda x: x["l"] + x["p"])))
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    rest = F.aggregate(F.transform("_p", lambda x, i: F.when(i == F.col("_best"), 0.0).otherwise(x)), F.lit(0.0), lambda a, b: a + b)
    top = F.array_max(logs)
    pl = F.transform(logs, lambda x: F.least(F.lit(MAX_Q), F.floor(-10 * (x - top) / math.log(10) + 0.5).cast("int")))
    out = out.withColumn("_best", best).withColumn("gt", F.get(F.array(*map(F.lit, GENOTYPES)), F.col("_best")))
    return out.withColumn("gq", prob.phred(rest, MAX_Q)).withColumn("pl", pl).withColumn("p_ref", F.get("_p", F.lit(0))).select(*keys, sample, "gt", "gq", "pl", "p_ref")


def diploid_quality(called: DataFrame, keys=("event",)) -> DataFrame:
    """qual of each event: how sure it is that not every sample is reference."""
    none = F.exp(F.sum(F.log(F.greatest("p_ref", F.lit(1e-300)))))
    return called.groupBy(*keys).agg(prob.phred(none, MAX_Q).alias("qual"))


def sample_filters(called: DataFrame) -> DataFrame:
    """Adds ft, the labels of each sample's call."""
    labels = F.array(F.when(F.col("gt") == "REF", F.lit("HomRef")), F.when(F.col("gq") < MIN_GQ, F.lit("MinGQ")))
    return called.withColumn("ft", F.array_sort(F.array_compact(labels)))


def _most(junctions: DataFrame, bad: Column, keys) -> DataFrame:
    return junctions.groupBy(*keys).agg((F.count_if(F.coalesce(bad, F.lit(False))) * 2 > F.count("*")).alias("_bad"))


def junction_filters(junctions: DataFrame, keys=("event",), pair_filter: bool = False, max_pair_size: Column | None = None) -> DataFrame:
    """MaxDepth, MaxMQ0Frac and NoPairSupport of each event: labels that more than half of its junctions earn.

    junctions has bp1_depth, bp2_depth, bp1_limit, bp2_limit, bp1_mq0, bp2_mq0, size, and kind and spanning for NoPairSupport.
    """
    deep = (F.col("bp1_depth") > F.col("bp1_limit")) | (F.col("bp2_depth") > F.col("bp2_limit"))
    mq0 = (F.col("size") < MQ0_SIZE) & ((F.col("bp1_mq0") > MAX_MQ0) | (F.col("bp2_mq0") > MAX_MQ0))
    tests = {"MaxDepth": deep, "MaxMQ0Frac": mq0}
    if pair_filter:
        tests["NoPairSupport"] = (F.col("kind") != "INSERT") & (F.col("size") >= (F.lit(1000) if max_pair_size is None else max_pair_size)) & (F.col("spanning") == 0)
    majority = [(F.count_if(F.coalesce(t, F.lit(False))) * 2 > F.count("*")).alias(label) for label, t in tests.items()]
    counted = junctions.groupBy(*keys).agg(*majority)
    return counted.select(*keys, F.array_compact(F.array(*[F.when(F.col(label), F.lit(label)) for label in tests])).alias("labels"))


def diploid_filters(called: DataFrame, junctions: DataFrame, keys=("event",), max_pair_size: Column | None = None) -> DataFrame:
    """qual and filters (sorted labels) of each event. max_pair_size: the size from which an event should have pairs."""
    samples = sample_filters(called).groupBy(*keys).agg(F.bool_and(F.size("ft") > 0).alias("_all"))
    out = diploid_quality(called, keys).join(samples, list(keys)).join(junction_filters(junctions, keys, True, max_pair_size), list(keys), "left")
    labels = F.concat(F.array_compact(F.array(F.when(F.col("qual") < MIN_QUAL, F.lit("MinQUAL")), F.when(F.col("_all"), F.lit("SampleFT")))), F.coalesce("labels", F.array().cast("array<string>")))
    return out.select(*keys, "qual", F.array_sort(F.array_distinct(labels)).alias("filters"))


def allele_frequency(counts: DataFrame, samples, keys=("event",), name: str = "freq") -> DataFrame:
    """Share of alt support in the named samples, from support_counts with pair_weight joined."""
    own = counts.where(F.col("sample").isin(*samples))
    support = lambda a: F.sum(F.floor(F.col(f"{a}_split") + F.col("pair_weight") * F.col(f"{a}_confident_spanning")))
    return own.groupBy(*keys).agg(F.coalesce(support("alt") / F.when(support("alt") + support("ref") > 0, support("alt") + support("ref")), F.lit(0.0)).alias(name))


def somatic(evidence: DataFrame, counts: DataFrame, normal, tumour, keys=("event",)) -> DataFrame:
    """score and tier of each event: how sure it is somatic and the normal sample reference, the lower of two tiers.

    evidence also has size, same_contig and junctions (how many the event has). The tumour is judged alike in both
    tiers; the permissive tier trusts the normal sample's weak evidence more.
    """
    freq = allele_frequency(counts, [tumour], keys, "_som").join(allele_frequency(counts, [normal, tumour], keys, "_noise"), list(keys), "full_outer").fillna(0.0, ["_som", "_noise"])
    large = evidence.groupBy(*keys).agg(F.max(large_noise_weight(F.col("size"), F.col("same_contig"))).alias("_large"), F.max("junctions").alias("_junctions"))
    noise_prior = F.log((1 - F.col("_large")) * SMALL_NOISE_PRIOR + F.col("_large") * LARGE_NOISE_PRIOR)
    fixed = (GERMLINE_PRIOR, GERMLINE_PRIOR / 2, SOMATIC_PRIOR)
    priors = [F.lit(math.log(1 - sum(fixed) - LARGE_NOISE_PRIOR)), F.lit(math.log(fixed[0])), F.lit(math.log(fixed[1])), F.lit(math.log(fixed[2])), noise_prior]
    zero = lambda df, names: df.fillna(0.0, names)

    def states(rows: DataFrame, single: dict, several: dict, som: Column, tag: str) -> DataFrame:
        """Sums over fragments of the log mixture of each state; events of several junctions have stricter chimera rates."""
        parts = []
        for options, here in ((single, F.col("junctions") == 1), (several, F.col("junctions") > 1)):
            parts.append(fragment_likelihoods(rows.where(here), **options))
        both = parts[0].unionByName(parts[1]).join(freq, list(keys), "left").fillna(0.0, ["_som", "_noise"])
        fractions = (F.lit(0.0), F.lit(0.5), F.lit(1.0), som, F.col("_noise"))
        return both.groupBy(*keys).agg(*[F.sum(_mixture(f)).alias(f"_{tag}{k}") for k, f in enumerate(fractions)])

    n, t = evidence.where(F.col("sample") == normal), evidence.where(F.col("sample") == tumour)
    rates = lambda c, alt, other, **more: {"ref_chimera": other, "alt_chimera": c, "alt_map": alt, **more}
    base = large.join(states(t, rates(1e-4, 1e-4, 1e-4), rates(2e-5, 1e-4, 2e-5), F.col("_som"), "t"), list(keys), "left")
    base = zero(base, [f"_t{k}" for k in range(5)])
    germ = n.groupBy(*keys).agg(F.count("*").alias("_seen"))
    normal_sums = fragment_likelihoods(n).groupBy(*keys).agg(*[F.sum(_mixture(F.lit(f))).alias(f"_d{k}") for k, f in enumerate(ALT_FRACTION)])
    base = zero(base.join(germ.join(normal_sums, list(keys), "left"), list(keys), "left"), [f"_d{k}" for k in range(3)])
    tiers = (
        (rates(1e-4, 1e-4, 1e-4), rates(2e-5, 1e-4, 2e-5)),
        (rates(5e-6, 1e-6, 1e-4, permissive=True, semi_mapped_power=1.0), rates(5e-6, 1e-6, 2e-5, permissive=True, semi_mapped_power=1.0)),
    )
    for k, (single, several) in enumerate(tiers):
        tag = f"n{k}_"
        base = zero(base.join(states(n, single, several, F.lit(0.0), tag), list(keys), "left"), [f"_{tag}{i}" for i in range(5)])
        p = prob.normalised(F.array(*[F.col(f"_t{i}") + F.col(f"_{tag}{i}") + priors[i] for i in range(5)]))
        base = base.withColumn(f"_not{k}", sum((F.get(p, F.lit(i)) for i in (1, 2, 4)), F.get(p, F.lit(0))))
    ref = prob.normalised(F.array(*[F.col(f"_d{k}") for k in range(3)]))
    base = base.withColumn("_alt", F.get(ref, F.lit(1)) + F.get(ref, F.lit(2)))
    score = lambda k: prob.phred(F.col(f"_not{k}") + F.col("_alt") - F.col(f"_not{k}") * F.col("_alt"), 3000)
    base = base.withColumn("_s0", score(0)).withColumn("_s1", F.when(F.col("_s0") > 0, score(1)).otherwise(0))
    return base.select(*keys, F.least("_s0", "_s1").alias("score"), (F.col("_s1") > F.col("_s0")).cast("int").alias("tier"))


def somatic_filters(scored: DataFrame, junctions: DataFrame, keys=("event",)) -> DataFrame:
    out = scored.join(junction_filters(junctions, keys), list(keys), "left")
    labels = F.concat(F.array_compact(F.array(F.when(F.col("score") < MIN_SOMATIC, F.lit("MinSomaticScore")))), F.coalesce("labels", F.array().cast("array<string>")))
    return out.select(*keys, "score", "tier", F.array_sort(labels).alias("filters"))


def tumour_filters(junctions: DataFrame, keys=("event",)) -> DataFrame:
    """Tumour-only events have no score, only depth and mapping filters."""
    return junction_filters(junctions, keys).select(*keys, F.array_sort("labels").alias("filters"))


def rna_filters(junctions: DataFrame, keys=("event",)) -> DataFrame:
    """Labels of RNA events from imprecise, same_contig, size, and split and spanning support of the junction."""
    labels = F.array_compact(
        F.array(
            F.when(F.col("imprecise"), F.lit("Imprecise")),
            F.when(F.col("same_contig") & (F.col("size") < LOCAL_SIZE), F.lit("Local")),
            F.when((F.col("split") == 0) | (F.col("spanning") == 0), F.lit("LowEvidence")),
        )
    )
    return junctions.select(*keys, F.lit(RNA_SCORE).alias("score"), F.array_sort(labels).alias("filters"))


def consistent_genotypes(called: DataFrame, keys=("event",), most: float = 0.9) -> DataFrame:
    """Whether junctions of an event (rows by junction and sample, with p_ref) agree on reference or not."""
    return called.groupBy(*keys, "sample").agg((F.max("p_ref") - F.min("p_ref") <= most).alias("_ok")).groupBy(*keys).agg(F.bool_and("_ok").alias("consistent"))


def routed(junctions: DataFrame, joint: DataFrame, single: DataFrame, least: Column) -> DataFrame:
    """Junctions with the score that counts: the joint one where it is at least the best single one. All or none of an event's junctions are written.

    junctions has event, junction; joint has event, score; single has event, junction, score.
    """
    best = single.groupBy("event").agg(F.max("score").alias("_best"))
    out = junctions.join(joint.select("event", F.col("score").alias("_joint")), "event", "left").join(best, "event", "left").join(single.select("event", "junction", F.col("score").alias("_own")), ["event", "junction"], "left")
    together = F.coalesce(F.col("_joint") >= F.col("_best"), F.lit(False))
    score = F.when(together, F.col("_joint")).otherwise(F.col("_own"))
    written = F.when(together, F.col("_joint") >= least).otherwise(F.col("_own") >= least)
    return out.withColumns({"is_joint": together, "score": score, "written": F.coalesce(written, F.lit(False))}).drop("_joint", "_best", "_own")


def breakend_depth(reads: DataFrame, breakends: DataFrame, pad: int = 50, least: int = 10) -> DataFrame:
    """max_depth and mq0 (share of reads of mapping quality 0, from `least` reads on) about each breakend (id, tid, center)."""
    from . import intervals

    around = breakends.select("id", F.col("tid").alias("b_tid"), (F.col("center") - pad).alias("b_begin"), (F.col("center") + pad + 1).alias("b_end"))
    hit = intervals.overlap_join(reads.select("tid", "begin", "end", "mapq"), around, right_cols=("b_tid", "b_begin", "b_end"))
    inside = hit.withColumn("begin", F.greatest("begin", "b_begin")).withColumn("end", F.least("end", "b_end"))
    peak = intervals.region_peak(inside, ("id",))
    share = hit.groupBy("id").agg(F.when(F.count("*") >= least, F.count_if(F.col("mapq") == 0) / F.count("*")).otherwise(0.0).alias("mq0"))
    return breakends.select("id").join(peak.withColumnRenamed("peak", "max_depth"), "id", "left").join(share, "id", "left").fillna(0, ["max_depth"]).fillna(0.0, ["mq0"])
