import random

import pytest
from pyspark.sql import functions as F

from helixloom.functions import cigar, prob, seq
from helixloom.operators import candidates, graph, intervals, observations, partitioning, scoring, stats, vcf
from helixloom.operators import reads as R

FLAGS = "qname string, flag int, sample int, tid int, pos0 int, mapq int, cigar string, mate_tid int, mate_pos0 int, tlen int, seq string, qual array<int>, sa string, mc string"


def read(name="r", flag=3, pos=100, cig="50M", mate_tid=0, mate_pos=200, tlen=150, tid=0, mapq=50, sa=None, mc=None, sample=0):
    n = sum(int(x) for x, op in __import__("re").findall(r"(\d+)([MIS=X])", cig))
    return (name, flag, sample, tid, pos, mapq, cig, mate_tid, mate_pos, tlen, "A" * n, [30] * n, sa, mc)


def table(spark, *rows):
    return R.with_flags(spark.createDataFrame(list(rows), FLAGS))


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([(0, "ctgA", 5000), (1, "ctgB", 5000)], "tid int, label string, length int")


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(i, rng.randrange(3), b := rng.randrange(300_000), b + rng.choice([1, 50, 1500, 90_000, 200_000])) for i in range(n)]
    a, b = make(80), make(90)
    left, right = spark.createDataFrame(a, "a long, tid int, begin long, end long"), spark.createDataFrame(b, "b long, t2 int, b2 long, e2 long")
    expected = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    got = intervals.overlap_join(left, right, right_cols=("t2", "b2", "e2")).select("a", "b").collect()
    assert sorted(map(tuple, got)) == expected
    right = right.toDF("b", "tid", "begin", "end")
    hit = {x for x, _ in expected}
    assert {r.a for r in intervals.overlap_join(left, right, "left_semi").collect()} == hit
    assert {r.a for r in intervals.overlap_join(left, right, "left_anti").collect()} == {x[0] for x in a} - hit


def test_few_pairs_meet_that_do_not_overlap(spark):
    """Disjoint intervals on one contig, with a few long ones: what meets in bins grows with the rows, not with their square."""
    for n in (2000, 8000):
        rows = [(i, 0, i * 1000, i * 1000 + 150) for i in range(n)] + [(n + k, 0, k * 100_000, k * 100_000 + 50_000) for k in range(n // 200)]
        a = spark.createDataFrame(rows, "a long, _tid int, _lb long, _le long")
        b = a.toDF("b", "_rtid", "_rb", "_re")
        met = intervals.candidates(a, b).count()
        assert met < 12 * n, met


def test_islands_touching_and_peaks(spark):
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "tid int, begin long, end long")
    n = lambda rows, touching: intervals.merged(make(rows), touching=touching).count()
    assert n([(5, 10), (2, 3), (2, 5)], True) == 1 and n([(5, 10), (2, 3), (2, 4)], True) == 2
    assert n([(5, 10), (2, 5)], False) == 2
    rows = [(1, 15, 19), (2, 5, 10), (1, 10, 20), (1, 24, 50), (2, 8, 10), (1, 15, 22)]
    df = spark.createDataFrame(rows, "tid int, begin long, end long")
    assert sorted((r.tid, r.begin, r.end) for r in intervals.merged(df).collect()) == [(1, 10, 22), (1, 24, 50), (2, 5, 10)]
    w = spark.createDataFrame([(0, 3, 7, 1), (0, 4, 5, 2)], "tid int, begin long, end long, w long")
    assert intervals.region_peak(w, weight=F.col("w")).first().peak == 3


def test_distribution_cases(spark):
    h = spark.createDataFrame([("s", i, 1) for i in (1, 2, 3, 4)], "sample string, size long, n long")
    cdf = stats.size_cdf(h, ["sample"])
    assert {r["size"]: r.below / r.total for r in cdf.collect()} == {1: 0.25, 2: 0.5, 3: 0.75, 4: 1.0}
    q = lambda p: stats.quantile(cdf, ["sample"], p).first()["size"]
    assert [q(p) for p in (0, 0.25, 0.5, 0.74, 0.75, 0.76, 1)] == [1, 1, 2, 3, 3, 4, 4]
    t = stats.trimmed(h, ["sample"], 0.5)
    assert t.agg(F.sum("n")).first()[0] == 2
    assert stats.quantile(stats.size_cdf(t, ["sample"]), ["sample"], 0.75).first()["size"] == 2
    assert stats.size_cdf(h.limit(0), ["sample"]).count() == 0
    m = lambda xs: stats.median_depth(spark.createDataFrame([("c", x) for x in xs], "c string, d int"), ["c"], "d").first().median_depth
    assert m([0, 2, 1, 3]) == 2 and m([0, 2, 1, 3, 4]) == 2.5 and m([0]) == 0


def test_read_filter_cases(spark):
    rows = [read("plain"), read("qc", 512 | 3), read("dup", 1024 | 3), read("supp", 2048 | 3), read("suppsa", 2048 | 3, sa="x"), read("sec", 256 | 3), read("secsa", 256 | 3, sa="x")]
    kept = {r.qname for r in table(spark, *rows).where(~R.core_filtered()).collect()}
    assert kept == {"plain", "suppsa", "secsa"}


def test_pair_classes(spark):
    rows = [
        read("innie", 3 | 32, 100, mate_pos=200, tlen=150), read("equal", 3 | 32, 100, mate_pos=100, tlen=60), read("outie", 3 | 16, 100, mate_pos=300), read("same", 3, 100),
        read("far", 3 | 32, 100, mate_pos=4000, tlen=3900), read("other", 3 | 32, 100, mate_tid=1), read("unmapped", 3 | 8),
    ]
    df = table(spark, *rows).withColumns({"pp_min": F.lit(50), "pp_max": F.lit(200)})
    got = {r.qname: (r.i, r.a, r.c) for r in df.select("qname", R.innie().alias("i"), R.non_compressed_anomalous().alias("a"), R.size_class().alias("c")).collect()}
    assert got["innie"] == (True, False, "NORMAL") and got["equal"][0] and not got["outie"][0] and got["outie"][1] and got["same"][1]
    assert got["far"] == (True, True, "DISTANT") and got["other"][1] and not got["unmapped"][1]


def test_malformed_records_raise(spark):
    bad = spark.createDataFrame([(*read()[:10], "A=A", [1, 2, 3], None, None)], FLAGS)
    with pytest.raises(Exception, match="illegal base|Bad alignment"):
        R.checked(R.with_flags(bad)).collect()
    with pytest.raises(Exception, match="Can't parse CIGAR"):
        spark.range(1).select(cigar.parse(F.lit("5Q"))).collect()


def test_cigar_functions(spark):
    c = cigar.parse(F.lit("2H3S10M2I5D4=1X6N7M4S"))
    r = spark.range(1).select(
        cigar.read_length(c).alias("read"), cigar.ref_length(c).alias("ref"), cigar.matched_length(c).alias("m"), cigar.spliced_length(c).alias("n"), cigar.clip_lead(c).alias("lead"), cigar.clip_trail(c).alias("trail"),
        cigar.soft_clip_lead(c).alias("soft"), cigar.indel_count(c).alias("i"), cigar.exon_count(c).alias("e"), cigar.text(c).alias("t"), cigar.text(cigar.collapsed_matches(c)).alias("cm"),
        cigar.text(cigar.limited_to_read(c, F.lit(3), F.lit(15))).alias("lr"), cigar.text(cigar.limited_to_ref(c, F.lit(0), F.lit(12))).alias("lf"), cigar.text(cigar.matchified(c)).alias("mf"),
        cigar.invalid_reason(c, F.lit(31)).alias("ok"), cigar.invalid_reason(c, F.lit(30)).alias("bad"), cigar.insert_lead(cigar.parse(F.lit("3I5M"))).alias("il"),
    ).first()
    assert (r.read, r.ref, r.m, r.n, r.lead, r.trail, r.soft, r.i, r.e) == (31, 33, 22, 6, 5, 4, 3, 1, 2)
    assert r.t == "2H3S10M2I5D4=1X6N7M4S" and r.cm == "2H3S10M2I5D5M6N7M4S"
    assert r.lr == "10M2I" and r.lf == "10M2I2D" and r.mf.startswith("2H13M2I") and r.ok is None and r.bad == "wrong length" and r.il == 3


def test_sequence_functions(spark):
    r = spark.range(1).select(seq.reverse_complement(F.lit("AACGN")).alias("rc"), seq.repeat_unit(F.lit("ATATAT")).alias("u"), seq.repeat_unit(F.lit("ATG")).alias("v"), seq.standard(F.lit("acRgt")).alias("s"), seq.words(F.lit("ACGT"), 3).alias("w")).first()
    assert (r.rc, r.u, r.v, r.s, r.w) == ("NCGTT", "AT", "ATG", "ACNGT", ["ACG", "CGT"])


def test_indel_and_split_observations(spark, contigs):
    rows = [read("del", cig="30M20D30M", flag=0), read("ins", cig="30M12I30M", flag=0), read("edge", cig="12I40M", flag=0), read("swap", cig="30M10I15D30M", flag=0), read("small", cig="30M3D30M", flag=0)]
    got = {r.qname: r for r in observations.from_indels(table(spark, *rows), contigs).collect()}
    assert set(got) == {"del", "ins", "edge", "swap"}
    d = got["del"]
    assert (d.bp1_state, d.bp1_begin, d.bp1_end, d.bp2_state, d.bp2_begin, d.bp2_end) == (1, 110, 150, 2, 130, 170)
    assert (got["edge"].bp1_state, got["edge"].w_remote) == (3, 0) and got["swap"].bp2_begin == 125
    split = table(spark, read("a", 0, cig="30M20S", sa="ctgB,301,+,30S20M,60,0;"), read("low", 0, sa="ctgB,301,+,30S20M,3,0;"), read("two", 0, sa="ctgB,1,+,5M,60,0;ctgB,1,+,5M,60,0;"))
    s = observations.from_splits(split, contigs).collect()
    assert len(s) == 1 and (s[0].bp1_state, s[0].bp1_begin, s[0].bp2_state, s[0].bp2_tid, s[0].bp2_begin) == (1, 110, 2, 1, 280)
    with pytest.raises(Exception, match="unknown chromosome"):
        observations.from_splits(table(spark, read("x", 0, sa="chrNo,1,+,5M,60,0;")), contigs).collect()


def test_pair_observations(spark, contigs):
    limits = {"pp_min": F.lit(50), "pp_max": F.lit(125), "be_min": F.lit(75), "be_max": F.lit(100), "large_low": F.lit(1250), "large_high": F.lit(2500)}
    rows = [read("far", 3 | 32, 100, mate_pos=3000, tlen=2950), read("other", 3 | 32, 100, mate_tid=1, mate_pos=400), read("ok", 3 | 32, 100, mate_pos=150, tlen=100), read("end", 3 | 32, 4960, mate_tid=1)]
    got = {r.qname: r for r in observations.from_pairs(table(spark, *rows).withColumns(limits), contigs).collect()}
    assert set(got) == {"far", "other"}
    f = got["far"]
    assert (f.bp1_state, f.bp1_begin, f.bp1_end, f.bp2_state, f.bp2_begin, f.bp2_end, f.w_local) == (1, 150, 190, 2, 2960, 3000, 3)


def test_edge_scan():
    ref = "ACGTTGCAAGGTCCATTGACCAGT" * 4
    s = ref[10:60]
    assert observations.edge_lengths(s, [("M", 50)], 10, ref, 0) == (0, 10, 0, 60)
    bad = "T" * 9 + s[9:]
    n, at, t, _ = observations.edge_lengths(bad, [("S", 9), ("M", 41)], 19, ref, 0)
    assert (n, at, t) == (9, 19, 0) or n <= 9
    n, _, t, at = observations.edge_lengths(s[:40] + "G" * 10, [("M", 50)], 10, ref, 0)
    assert n == 0 and 6 <= t <= 10 and at == 60 - t


def test_merge_of_identical_loci(spark):
    node = lambda t, b, e: {"tid": t, "begin": b, "end": e}
    schema = "a struct<tid:int,begin:int,end:int>, b struct<tid:int,begin:int,end:int>, w long"
    one = [(node(1, 10, 20), node(2, 30, 40), 1), (node(2, 30, 40), node(1, 10, 20), 0)]
    nodes, edges = graph.merge(spark.createDataFrame(one * 2, schema), 2)
    assert nodes.count() == 2 and edges.count() == 2 and nodes.select("locus").distinct().count() == 1
    pairs = graph.paired(edges)
    assert pairs.count() == 1 and graph.checks(nodes, pairs, 2).count() == 0
    # transitive merge: three loci whose second nodes overlap
    rows = []
    for t, b, e in ((1, 30, 40), (2, 50, 60), (3, 35, 55)):
        rows += [(node(t, 10, 20), node(12, b, e), 1), (node(12, b, e), node(t, 10, 20), 1)]
    nodes, edges = graph.merge(spark.createDataFrame(rows, schema), 1)
    assert nodes.count() == 4 and nodes.select("locus").distinct().count() == 1
    assert (30, 60) in {(r.begin, r.end) for r in nodes.where("tid = 12").collect()}
    # evidence below the threshold does not merge
    nodes, _ = graph.merge(spark.createDataFrame(rows, schema), 9)
    assert nodes.where("tid = 12").count() == 3


def test_graph_files_and_dump(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, 0, 5, 9), (1, 2, 0, 50, 90)], "locus long, node long, tid int, begin int, end int")
    edges = spark.createDataFrame([(1, 1, 2, 9, 12)], "locus long, n1 long, n2 long, count_fwd long, count_rev long")
    graph.save(nodes, edges, str(tmp_path))
    n, e = graph.load(spark, str(tmp_path))
    assert [r.line for r in graph.dump(n, e).collect()] == ["locus 1 node 1 0:[5,9) -> 2:9:12", "locus 1 node 2 0:[50,90) -> 1:12:9"]
    assert graph.in_region(n, 0, 8, 20).count() == 1
    assert graph.isolated(spark.createDataFrame([(1, 1, 1, 9, 9)], "locus long, n1 long, n2 long, count_fwd long, count_rev long")).first().is_skipped


def test_clusters_and_types(spark):
    base = {"locus": 1, "n1": 1, "n2": 2, "sample": 0, "read_no": 1, "ev_type": "PAIR", "bp1_state": 1, "bp1_tid": 0, "bp1_begin": 100, "bp1_end": 150, "bp2_state": 2, "bp2_tid": 0, "bp2_begin": 900, "bp2_end": 950, "w_local": 3, "w_remote": 3, "r1_tid": 0, "r1_pos": 100, "r2_tid": 0, "r2_pos": 950}
    rows = [base | {"qname": f"q{i}", "bp1_begin": 100 + i, "bp1_end": 150 + i, "r1_pos": 100 + i} for i in range(5)]
    rows.append(base | {"qname": "swap", "bp1_state": 2, "bp1_begin": 905, "bp1_end": 940, "bp2_state": 1, "bp2_begin": 110, "bp2_end": 140})
    rows.append(base | {"qname": "else", "bp2_begin": 3000, "bp2_end": 3100})
    found = candidates.clustered(spark.createDataFrame(rows)).orderBy("cand").collect()
    assert sorted(r.n_fragments for r in found) == [1, 6]
    big = max(found, key=lambda r: r.n_fragments)
    assert (big.bp1_begin, big.bp1_end, big.bp2_begin, big.bp2_end) == (100, 154, 900, 950)
    df = spark.createDataFrame(found).withColumn("kind", candidates.sv_type())
    assert {r.kind for r in df.collect()} == {"INDEL"}
    rates = spark.createDataFrame([(0, 0.01, 0.01), (1, 0.5, 0.5)], "sample int, anomalous_rate double, assembly_rate double")
    background = spark.createDataFrame([(s, 0, p) for p in range(1000) for s in (0, 1)], "sample int, tid int, pos0 long")
    tested = candidates.filtered(candidates.with_significance(df, rates, background))
    assert {r.n_fragments: r.mark for r in tested.collect()} == {6: None, 1: "SPANNING_LOW_SIGNAL"}
    events = candidates.event_filter(candidates.junction_pairs(tested))
    assert [r.n_fragments for r in events.collect()] == [6]


def test_signal_counts_background_reads(spark):
    """Five observations in a window of four intervals; the reads between them are the trials, per sample and breakend."""
    rng = random.Random(6)
    reads = [(s, t, rng.randrange(3_000_000)) for s in (0, 1) for t in (0, 1) for _ in range(400)]
    places = [(c, s, bp, rng.randrange(2), rng.randrange(3_000_000)) for c in range(8) for s in (0, 1) for bp in (1, 2) for _ in range(rng.randrange(9))]
    rows = [(1, 1, 2, c, 3 if c % 2 else 1, [(s, bp, t, p) for d, s, bp, t, p in places if d == c]) for c in range(8)]
    df = spark.createDataFrame(rows, "locus long, n1 long, n2 long, cand int, bp1_state int, evidence array<struct<sample:int,bp:int,tid:int,pos:long>>")
    rates = {0: (0.3, 0.1), 1: (0.2, 0.4)}
    got = {r.cand: r.p_signal for r in candidates.with_significance(df, spark.createDataFrame([(s, *r) for s, r in rates.items()], "sample int, anomalous_rate double, assembly_rate double"), spark.createDataFrame(reads, "sample int, tid int, pos0 long")).collect()}
    for c in range(8):
        best = 1.0
        for s in (0, 1):
            for bp in (1,) if c % 2 else (1, 2):
                at = sorted(sum(x[0] == s and x[1:] <= (t, p) for x in reads) for d, s2, b, t, p in places if (d, s2, b) == (c, s, bp))
                w = min(4, len(at) - 1)
                if w > 0:
                    trials = min(y - x for x, y in zip(at, at[w:]))
                    hits = min(w, trials)
                    best = min(best, prob._tail(hits, trials, rates[s][c % 2]) if hits else 1.0)
        assert got[c] == pytest.approx(best), c


def test_probabilities(spark):
    df = spark.createDataFrame([(3, 10, 0.1), (0, 5, 0.5), (5, 5, 0.5)], "k int, n int, p double")
    got = [r[0] for r in df.select(prob.binomial_tail("k", "n", "p")).collect()]
    assert got == pytest.approx([0.0701908264, 1.0, 0.03125])
    r = spark.range(1).select(prob.normalised(F.array(F.lit(-1000.0), F.lit(-1000.0))).alias("n"), prob.log_sum2(F.lit(0.0), F.lit(0.0)).alias("l"), prob.phred(F.lit(0.0), 999).alias("q"), prob.ramp(F.lit(15), 10, 20).alias("r")).first()
    assert list(r.n) == [0.5, 0.5] and r.l == pytest.approx(0.6931471805) and r.q == 999 and r.r == 0.5


def evidence(event, sample, ref, alt, n, **more):
    row = {"event": event, "junction": 0, "sample": sample, "ref_pair": ref, "alt_pair": alt, "pair_weight": 1.0, "size": 20_000, "same_contig": True, "junctions": 1, "imprecise": False}
    for k in ("r1", "r2"):
        row |= {f"{k}_scanned": True, f"{k}_anchored": True, f"{k}_anchored2": True, f"{k}_split": False, f"{k}_split2": False, f"{k}_ref_lnl": 0.0, f"{k}_alt_lnl": 0.0}
    return [row | more | {"qname": f"{event}/{sample}/{i}/{ref}"} for i in range(n)]


def test_models(spark):
    rows = evidence("het", "n", 0.4, 0.001, 15) + evidence("het", "n", 0.001, 0.4, 15) + evidence("ref", "n", 0.4, 0.001, 30) + evidence("hom", "n", 0.001, 0.4, 30)
    df = spark.createDataFrame(rows)
    got = {r.event: r for r in scoring.diploid(df).collect()}
    assert {k: r.gt for k, r in got.items()} == {"het": "HET", "ref": "REF", "hom": "HOM"}
    assert got["het"].pl[1] == 0 and got["het"].gq > 50
    q = {r.event: r.qual for r in scoring.diploid_quality(scoring.diploid(df)).collect()}
    assert q["ref"] == 0 and q["het"] > 100
    junctions = spark.createDataFrame([("het", 50, 5, 20, 20, 0.0, 0.5, 100, "DELETE", 3), ("ref", 5, 5, 20, 20, 0.0, 0.0, 5000, "DELETE", 0), ("hom", 5, 5, 20, 20, 0.0, 0.5, 5000, "DELETE", 3)], "event string, bp1_depth int, bp2_depth int, bp1_limit int, bp2_limit int, bp1_mq0 double, bp2_mq0 double, size int, kind string, spanning int")
    labels = {r.event: r.filters for r in scoring.diploid_filters(scoring.diploid(df), junctions).collect()}
    assert labels == {"het": ["MaxDepth", "MaxMQ0Frac"], "ref": ["MinQUAL", "NoPairSupport", "SampleFT"], "hom": []}
    t = evidence("som", "n", 0.4, 0.001, 40) + evidence("som", "t", 0.001, 0.4, 20) + evidence("som", "t", 0.4, 0.001, 20) + evidence("germ", "n", 0.001, 0.4, 20) + evidence("germ", "n", 0.4, 0.001, 20) + evidence("germ", "t", 0.001, 0.4, 20) + evidence("germ", "t", 0.4, 0.001, 20)
    e = spark.createDataFrame(t)
    s = {r.event: r.score for r in scoring.somatic(e, scoring.support_counts(e).withColumn("pair_weight", F.lit(1.0)), "n", "t").collect()}
    assert s["som"] >= 30 and s["germ"] == 0


def test_conflicts(spark):
    rows = evidence("a", "n", None, 0.4, 1, r1_split=True, r1_ref_lnl=-1.0, r1_alt_lnl=-50.0, size=100) + evidence("b", "n", None, 0.4, 1, r1_split=True, r1_ref_lnl=-1.0, r1_alt_lnl=-50.0, size=5000)
    df = spark.createDataFrame([(r["event"], 0.4, None, True, -1.0, -50.0, False, 0.0, 0.0, r["size"], False) for r in rows], "event string, alt_pair double, ref_pair double, r1_split boolean, r1_ref_lnl double, r1_alt_lnl double, r2_split boolean, r2_ref_lnl double, r2_alt_lnl double, size int, imprecise boolean")
    assert {r.event: r.alt_pair for r in scoring.resolved_conflicts(df).collect()} == {"a": None, "b": 0.4}


VCF = "chrom string, pos int, id string, ref string, alt string, qual double, filter array<string>, info string, format string, samples array<string>"


def record(i, pos, alt="<DEL>", qual=20.0, flt=(), info="END=1100;SVTYPE=DEL;SVLEN=-1000", samples=("1/1",), chrom="ctgA"):
    return (chrom, pos, i, "A", alt, qual, list(flt), info, "GT", list(samples))


def test_vcf_dedupe_ploidy_and_inversions(spark, contigs):
    make = lambda *rows: spark.createDataFrame(list(rows), VCF)
    ids = lambda df: sorted(r.id for r in df.collect())
    pair = make(record("pass", 100), record("high", 100, qual=900.0, flt=["x"]))
    assert ids(vcf.deduplicated(pair, contigs)) == ["pass"] == ids(vcf.best_of_equal(pair))
    bnd = make(record("a:0", 100, "A[ctgB:5[", info="SVTYPE=BND;MATEID=a:1"), record("b:0", 100, "A[ctgB:5[", 50.0, info="SVTYPE=BND;MATEID=b:1"), record("a:1", 5, "]ctgA:100]A", info="SVTYPE=BND;MATEID=a:0", chrom="ctgB"), record("b:1", 5, "]ctgA:100]A", 50.0, info="SVTYPE=BND;MATEID=b:0", chrom="ctgB"))
    assert ids(vcf.deduplicated(bnd, contigs)) == ["b:0", "b:1"]
    stacked = make(record("x", 100), record("y", 150, info="END=1050;SVTYPE=DEL;SVLEN=-900"), record("z", 160, info="END=560;SVTYPE=DEL;SVLEN=-400"))
    assert {r.id: r.filter for r in vcf.ploidy_filtered(stacked).collect()} == {"x": ["Ploidy"], "y": ["Ploidy"], "z": []}
    inv = make(record("i:0", 100, "[ctgA:200[T", info="SVTYPE=BND;MATEID=i:1"), record("i:1", 200, "[ctgA:100[G", info="SVTYPE=BND;MATEID=i:0"), record("j:0", 300, "T]ctgA:400]", info="SVTYPE=BND;MATEID=j:1"), record("j:1", 400, "T]ctgA:300]", info="SVTYPE=BND;MATEID=j:0"), record("k:0", 5, "T]ctgB:9]", info="SVTYPE=BND;MATEID=k:1"), record("k:1", 9, "T]ctgA:5]", info="SVTYPE=BND;MATEID=k:0", chrom="ctgB"))
    got = {r.id: (r.pos, r.alt, r.info) for r in vcf.inversions(inv).collect()}
    assert set(got) == {"i", "j", "k:0", "k:1"} and got["i"][0] == 99 and "INV5" in got["i"][2] and "END=199" in got["i"][2] and got["j"][0] == 300 and "INV3" in got["j"][2]


def test_vcf_small_steps(spark, contigs):
    make = lambda *rows: spark.createDataFrame(list(rows), VCF)
    trio = make(record("ok", 1, samples=("0/1", "0/0", "0/1")), record("new", 2, samples=("0/1", "0/0", "0/0")))
    assert {r.id: r.dq for r in vcf.de_novo(trio, 0, 1, 2).collect()} == {"ok": 0, "new": 60}
    small = spark.createDataFrame([("c", 1, "a", "A" * 9, "A", 1.0, [], "", None, []), ("c", 1, "b", "A" * 10, "A", 1.0, [], "", None, []), ("c", 1, "d", "A", "<INS>", 1.0, [], "", None, [])], VCF)
    assert [r.id for r in vcf.small_indels(small).collect()] == ["a"]
    ft = spark.createDataFrame([("c", 1, "a", "A", "T", 1.0, [], "", "GT:FT", ["0/1:MinGQ"]), ("c", 1, "b", "A", "T", 1.0, ["SampleFT"], "", "GT:FT", ["0/1:PASS"])], VCF)
    assert {r.id: r.filter for r in vcf.sample_filter_refreshed(ft).collect()} == {"a": ["SampleFT"], "b": []}
    over = make(record("x", 1000, info="END=5000;SVTYPE=DEL"), record("y", 1500, info="END=1600;SVTYPE=DEL"), record("z", 9000, info="END=9100;SVTYPE=DEL"))
    assert sorted(r.id for r in vcf.without_overlaps(over).collect()) == ["y", "z"]
    assert vcf.with_command(["##a", "##cmdline=old", "#CHROM"], "new") == ["##a", "##cmdline=new", "#CHROM"]
    ev = spark.createDataFrame([("v", "ctgA", 99, 100, 1, "A", "ctgB", 199, 200, 2, "C", "GG", False, None, [])], "id string, chrom1 string, pos1 int, end1 int, state1 int, ref1 string, chrom2 string, pos2 int, end2 int, state2 int, ref2 string, insert_seq string, imprecise boolean, qual double, filter array<string>")
    assert {r.id: (r.pos, r.alt) for r in vcf.breakend_rows(ev).collect()} == {"v:0": (100, "AGG[ctgB:200["), "v:1": (200, "]ctgA:100]GGC")}
    ind = spark.createDataFrame([("d", "DELETE", "ctgA", 99, 103, "ACGT", "", False, "", 9.0, []), ("big", "DELETE", "ctgA", 99, 3000, "A", "", False, "", 9.0, [])], "id string, kind string, chrom string, pos int, end int, ref string, insert_seq string, imprecise boolean, homology string, qual double, filter array<string>")
    assert {r.id: (r.ref, r.alt, r.info) for r in vcf.indel_rows(ind).collect()} == {"d": ("ACGT", "A", "END=103;SVTYPE=DEL;SVLEN=-3;CIGAR=1M3D"), "big": ("A", "<DEL>", "END=3000;SVTYPE=DEL;SVLEN=-2900")}


def test_partitioning(spark, contigs):
    rows = partitioning.segments(contigs, 3000).orderBy("tid", "begin").collect()
    assert [(r.begin, r.end) for r in rows] == [(1, 2500), (2501, 5000)] * 2
    assert partitioning.grouped([("a", 100), ("b", 50), ("c", 300)], 200) == [["a", "b"], ["c"]]
    assert partitioning.parse_region("ctgA", {"ctgA": 500}) == ("ctgA", 0, 500)
    assert partitioning.parse_region("HLA:01:100-200", {"HLA:01": 500}) == ("HLA:01", 99, 200)
    for bad in ("chrNo", "ctgA:9-5", "ctgA:x"):
        with pytest.raises(ValueError):
            partitioning.parse_region(bad, {"ctgA": 500})
    bed = spark.createDataFrame([("ctgA", 10, 20), ("ctgA", 20, 30)], "chrom string, begin long, end long")
    reg = spark.createDataFrame([("ctgA", 15, 100)], "label string, begin long, end long")
    assert [tuple(r) for r in partitioning.callable_regions(reg, bed).collect()] == [("ctgA", 15, 30)]
    assert [r.label for r in partitioning.skipped_contigs(contigs, bed).collect()] == ["ctgB"]
    assert partitioning.depth_segments(250_000_000) == 16_000_000
    assert partitioning.contig_mismatches(contigs, contigs).count() == 0
