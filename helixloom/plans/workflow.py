"""The whole analysis as one application: alignments to scored, ordered variant records.

Options and their checks stand in for the command line; each step is a table, and the graph is stored, as every
later step starts from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar
from ..operators import candidates as C
from ..operators import graph as G
from ..operators import intervals, observations, partitioning, refinement, scoring, stats, support, vcf
from ..operators import reads as R


@dataclass(frozen=True)
class Options:
    normals: int = 1
    tumours: int = 0
    rna: bool = False
    unstranded: bool = False
    exome: bool = False
    regions: tuple[str, ...] = ()
    min_edge_observations: int = 3
    min_spanning: int = 3
    min_size: int = 8
    reads: R.Options = field(default_factory=R.Options)

    def __post_init__(self):
        if self.tumours > 1:
            raise ValueError("at most one tumour sample can be analysed")
        if self.tumours and self.normals > 1:
            raise ValueError("a tumour sample takes at most one normal sample")
        if self.rna and (self.normals, self.tumours) != (1, 0):
            raise ValueError("RNA analysis takes just one sample")
        if self.unstranded and not self.rna:
            raise ValueError("unstranded is an option of RNA analysis")
        if not self.normals and not self.tumours:
            raise ValueError("no sample is given")

    @property
    def threshold(self) -> int:
        return observations.WEIGHT * self.min_edge_observations

    @property
    def model(self) -> str:
        return "rna" if self.rna else "tumor" if self.tumours and not self.normals else "somatic" if self.tumours else "diploid"

    @property
    def depth_filter(self) -> bool:
        return not (self.exome or self.rna)


def fragment_statistics(reads: DataFrame) -> DataFrame:
    """The fragment-size histogram of each sample, its far end trimmed."""
    use = R.insert_size_reads(reads)
    return stats.trimmed(stats.size_histogram(use, ["sample"], "tlen"), ["sample"])


def contig_depths(reads: DataFrame, bases: int = 100) -> DataFrame:
    """Median depth of each contig, places without reads left out, over windows of `bases`."""
    use = reads.where(~R.mapped_filtered()).withColumn("begin", F.col("pos0")).withColumn("end", F.col("pos0") + F.length("seq"))
    runs = intervals.coverage(use)
    points = runs.select("tid", "depth", F.explode(F.sequence(F.expr(f"begin div {bases} * {bases}"), F.col("end") - 1, F.lit(bases).cast("long"))).alias("at")).where("at >= 0")
    return stats.median_depth(points, ["tid"], "depth").withColumnRenamed("median_depth", "depth")


def prepared(reads: DataFrame, histogram: DataFrame, options: Options) -> DataFrame:
    """Checked reads with flags and their sample's limits."""
    flagged = R.checked(R.with_flags(reads))
    return flagged.join(F.broadcast(R.sample_limits(histogram, options.reads)), "sample")


def build_graph(ready: DataFrame, contigs: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, nodes and cleaned paired edges."""
    found = G.checkpointed(observations.observations(ready, contigs, options.reads), "observations")
    nodes, edges = G.merge(observations.proto_edges(found), options.threshold)
    pairs = G.cleaned(G.paired(edges), options.threshold)
    return found, G.without_empty_nodes(nodes, pairs), pairs


def call_candidates(found: DataFrame, nodes: DataFrame, pairs: DataFrame, counts: DataFrame, reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Candidates of all bidirectional or self edges, tested against the reads of their samples, filtered and grouped to events."""
    use = G.without_hub_edges(pairs.where(G.bidirectional(options.threshold)))
    own = C.clustered(observations.collapsed_near_indels(C.of_edge(observations.fragments(found), nodes, use)))
    marked = C.filtered(C.with_significance(own, stats.noise_rates(counts), reads))
    events = C.event_filter(C.junction_pairs(marked), options.min_spanning)
    return events.where(C.is_complex() | ~C.below_size(options.min_size)).withColumn("kind", C.sv_type())


def records(calls: DataFrame, contigs: DataFrame, filters: DataFrame | None = None, exact: DataFrame | None = None) -> DataFrame:
    """Candidates as ordered records: breakend pairs, symbols or sequences for what lies on one contig.

    filters: locus, n1, n2, cand, qual, filter. exact: refined variants (of refinement.refined), which replace the imprecise ones.
    """
    keys = ["locus", "n1", "n2", "cand"]
    scored = calls.join(filters, keys, "left") if filters is not None else calls.withColumns({"qual": F.lit(None).cast("double"), "filter": F.array().cast("array<string>")})
    scored = scored.withColumns({"asm": F.lit(0), "seg": F.lit(0)}).withColumn("id", C.junction_id()).withColumn("filter", F.coalesce("filter", F.array().cast("array<string>")))
    named = lambda k: F.broadcast(contigs.select(F.col("tid").alias(f"bp{k}_tid"), F.col("label").alias(f"chrom{k}")))
    rough = scored if exact is None else scored.join(exact.select(*keys), keys, "left_anti")
    df = rough.join(named(1), "bp1_tid").join(named(2), "bp2_tid")
    flat = df.select(
        "*", F.lit(True).alias("imprecise"), F.lit("").alias("insert_seq"), *[F.col(f"bp{k}_begin").alias(f"pos{k}") for k in (1, 2)], *[F.col(f"bp{k}_end").alias(f"end{k}") for k in (1, 2)],
        *[F.col(f"bp{k}_state").alias(f"state{k}") for k in (1, 2)], F.lit("N").alias("ref1"), F.lit("N").alias("ref2"),
    )
    pairs = vcf.breakend_rows(flat.where(F.col("kind").isin("INTERTRANSLOC", "INVERSION", "UNKNOWN")))
    low, high = F.least("bp1_begin", "bp2_begin"), F.greatest("bp1_end", "bp2_end")
    local = flat.where(F.col("kind").isin("INDEL", "TANDUP")).select("id", F.when(F.col("kind") == "INDEL", "DELETE").otherwise(F.col("kind")).alias("kind"), F.col("chrom1").alias("chrom"), low.alias("pos"), high.alias("end"), F.lit("N").alias("ref"), "insert_seq", "imprecise", F.lit("").alias("homology"), "qual", "filter")
    out = pairs.unionByName(vcf.indel_rows(local))
    if exact is not None:
        precise = exact.join(scored.select(*keys, "id", "qual", "filter"), keys)
        out = out.unionByName(vcf.indel_rows(refinement.indels(precise, contigs)))
    return vcf.deduplicated(out, contigs)


#: Depth, as a multiple of the contig's, above which reads are no evidence, and above which a breakend earns MaxDepth.
EVIDENCE_DEPTH, BREAKEND_DEPTH = 12.0, 3.0
#: Share of fragments beyond which a size is extreme: above the size there, a deletion should have pairs.
EXTREME_TRIM = 0.05
KEYS = ["locus", "n1", "n2", "cand"]


def in_shallow_places(ready: DataFrame, depths: DataFrame) -> DataFrame:
    """Reads that do not start where the depth is far above their contig's."""
    use = ready.where(~R.mapped_filtered())
    windows = intervals.coverage(use.select("tid", F.col("pos0").cast("long").alias("begin"), (F.col("pos0") + F.length("seq")).cast("long").alias("end")))
    return R.depth_filtered(ready, windows, depths, EVIDENCE_DEPTH).where("NOT is_deep").drop("is_deep")


def run(reads: DataFrame, contigs: DataFrame, options: Options = Options(), pieces: DataFrame | None = None) -> DataFrame:
    """Variant records of alignments, scored by the model that the options name.

    Samples are numbered, normal ones first. pieces: the reference (sources.text.chunked, with a margin of 20 kb), for
    exact breakends.
    """
    flagged = R.with_flags(in_regions(reads, contigs, options))
    histogram = G.checkpointed(fragment_statistics(flagged), "fragments")
    ready = prepared(flagged, histogram, options)
    depths = G.checkpointed(contig_depths(flagged), "depths") if options.depth_filter else None
    shallow = ready if depths is None else G.checkpointed(in_shallow_places(ready, depths), "shallow")
    counts = R.sample_counts(R.evidence(ready.where(~R.mapped_filtered()), options.reads), options.reads)
    found, nodes, pairs = build_graph(shallow, contigs, options)
    calls = G.checkpointed(call_candidates(found, nodes, pairs, counts, ready.where(~R.mapped_filtered()), options), "calls")
    exact = None
    if pieces is not None:
        event = F.concat_ws(":", "locus", "n1", "n2", "event")
        named = calls.select("locus", "n1", "n2", "cand", event.alias("event"), F.col("cand").alias("junction"))
        exact = G.checkpointed(refinement.refined(calls, ready, pieces).join(named, ["locus", "n1", "n2", "cand"]), "refined")
    return scored(calls, ready, histogram, contigs, options, exact, depths)


def in_regions(reads: DataFrame, contigs: DataFrame, options: Options) -> DataFrame:
    """The reads that start in one of the options' regions; all of them if there are none."""
    if not options.regions:
        return reads
    spark = reads.sparkSession
    named = partitioning.regions(spark.createDataFrame([(r,) for r in options.regions], "region string"), contigs)
    ranges = named.join(contigs.select("label", F.col("tid").alias("r_tid")), "label").select("r_tid", F.col("begin").alias("r_begin"), F.col("end").alias("r_end"))
    placed = reads.withColumn("_stop", F.col("pos0") + 1)
    inside = placed.join(F.broadcast(ranges), (F.col("tid") == F.col("r_tid")) & (F.col("pos0") < F.col("r_end")) & (F.col("pos0") >= F.col("r_begin")), "left_semi")  # a few named regions
    return inside.drop("_stop")


def breakend_limits(found: DataFrame, ready: DataFrame, depths: DataFrame | None) -> DataFrame:
    """event, junction, and depth, limit and mq0 of both breakends; without depths there are no limits."""
    ends = []
    for k in (1, 2):
        ends.append(found.select("event", "junction", F.lit(k).alias("k"), F.concat_ws("/", "event", "junction", F.lit(k)).alias("id"), F.col(f"b_tid{k}").alias("tid"), F.col(f"c{k}").alias("center")))
    points = ends[0].unionByName(ends[1])
    use = ready.where(~R.mapped_filtered()).select("tid", F.col("pos0").cast("long").alias("begin"), (F.col("pos0") + cigar.ref_length(F.col("path"))).cast("long").alias("end"), "mapq")
    seen = points.join(scoring.breakend_depth(use, points), "id")
    limit = F.lit(None).cast("double").alias("limit")
    seen = seen.withColumn("limit", limit) if depths is None else seen.join(F.broadcast(depths.select("tid", (F.col("depth") * BREAKEND_DEPTH).alias("limit"))), "tid", "left")
    own = lambda k, c, name: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"bp{k}_{name}")
    return seen.groupBy("event", "junction").agg(*[own(k, c, n) for k in (1, 2) for c, n in (("max_depth", "depth"), ("limit", "limit"), ("mq0", "mq0"))])


def scored(calls: DataFrame, ready: DataFrame, histogram: DataFrame, contigs: DataFrame, options: Options = Options(), exact: DataFrame | None = None, depths: DataFrame | None = None) -> DataFrame:
    """Records of candidates with the filters, scores and samples of the options' model."""
    found = support.junctions(calls)
    evidence = support.evidence(calls, ready, histogram, options.reads)
    if exact is not None:
        splits = support.split_reads(refinement.exact_junctions(exact), ready.where(~R.mapped_filtered()), refinement.alleles(exact))
        evidence = support.add_splits(evidence, G.checkpointed(splits, "splits"))
        precise = exact.select("event", "junction", F.lit(False).alias("_exact"))
        evidence = evidence.join(precise, ["event", "junction"], "left").withColumn("imprecise", F.coalesce("_exact", "imprecise")).drop("_exact")
        evidence = scoring.resolved_conflicts(evidence)
    evidence = G.checkpointed(evidence, "evidence")
    counts = G.checkpointed(scoring.support_counts(evidence), "counts")
    of_junction = counts.groupBy("event", "junction").agg(F.sum("alt_confident_spanning").alias("spanning"), F.sum("alt_split").alias("split"))
    judged = found.join(of_junction, ["event", "junction"], "left").fillna(0, ["spanning", "split"]).join(breakend_limits(found, ready, depths), ["event", "junction"], "left")
    if exact is not None:
        judged = judged.join(exact.select("event", "junction", F.lit(False).alias("_exact")), ["event", "junction"], "left").withColumn("imprecise", F.coalesce("_exact", F.lit(True)))
    else:
        judged = judged.withColumn("imprecise", F.lit(True))
    judged = G.checkpointed(judged, "judged")
    per_sample, tags = counts, None
    if options.model == "diploid":
        called = scoring.diploid(evidence)
        extreme = stats.quantile(stats.size_cdf(histogram, ["sample"]), ["sample"], 1 - EXTREME_TRIM).agg(F.max("size")).first()[0] or 0  # one number
        filters = scoring.diploid_filters(called, judged, max_pair_size=F.lit(extreme)).select("event", F.col("qual").cast("double").alias("qual"), F.col("filters").alias("filter"))
        per_sample = scoring.sample_filters(called).join(counts, ["event", "sample"])
    elif options.model == "somatic":
        weighted = counts.join(evidence.groupBy("event", "junction").agg(F.max("pair_weight").alias("pair_weight")), ["event", "junction"])
        result = scoring.somatic_filters(scoring.somatic(evidence, weighted, 0, 1), judged)
        filters = result.select("event", F.lit(None).cast("double").alias("qual"), F.col("filters").alias("filter"))
        tags = result.select("event", F.concat(F.lit("SOMATIC;SOMATICSCORE="), F.col("score").cast("string")).alias("tags"))
    elif options.model == "tumor":
        filters = scoring.tumour_filters(judged).select("event", F.lit(None).cast("double").alias("qual"), F.col("filters").alias("filter"))
    else:
        worst = scoring.rna_filters(judged).groupBy("event").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("filter"))
        filters = worst.select("event", F.col("score").cast("double").alias("qual"), "filter")
    out = records(calls, contigs, found.join(filters, "event").select(*KEYS, "qual", "filter"), exact)
    ident = found.select("event", "junction", F.concat_ws(":", F.lit("SV"), "kind", *KEYS, F.lit(0), F.lit(0)).alias("id"))
    ids = F.explode(F.array("id", F.concat("id", F.lit(":0")), F.concat("id", F.lit(":1")))).alias("id")
    if tags is not None:
        named = ident.join(tags, "event").select(ids, "tags")
        out = out.join(named, "id", "left").withColumn("info", F.concat_ws(";", "info", "tags")).select(*out.columns)
    samples = ident.join(per_sample, ["event", "junction"])
    both = samples.select(ids, *[c for c in samples.columns if c != "id"])
    return vcf.ordered(vcf.with_samples(out, both, options.model), contigs)
