"""Steps whose work or memory must not grow faster than the input, and rows that repeat."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.functions import cigar
from helixloom.operators import graph, intervals, observations, partitioning, support, vcf
from helixloom.operators import reads as R


def test_merged_inversions_equal_all_pairs(spark):
    """Ids may repeat ('.') or be missing: each record is judged by its own place."""
    rng = random.Random(3)
    rows = [(rng.choice([".", None, f"v{k}"]), rng.choice("xy"), p := rng.randrange(120), f"SVTYPE=INV;END={p + rng.randrange(90)}") for k in range(300)]
    rows += [("d", "x", 5, "SVTYPE=DEL;END=9"), (".", "x", 6, "X=1"), ("n", None, 7, "SVTYPE=INV;END=9")]
    df = spark.createDataFrame([(*r[:3], "A", r[3]) for r in rows], "id string, chrom string, pos int, ref string, info string")
    end = lambda r: int(r[3].split("END=")[1])

    def later(a):
        if a[1] is None or "INV" not in a[3]:
            return False
        near = lambda b: b[1] == a[1] and "INV" in b[3] and 0 <= a[2] - b[2] <= 4 and abs(end(a) - end(b)) <= 4
        return any(near(b) and (b[2] < a[2] or (b[0] is not None and a[0] is not None and b[0] < a[0])) for b in rows)

    key = lambda r: tuple("" if x is None else str(x) for x in r)
    expected = sorted(key(r) for r in rows if not later(r))
    got = sorted(key((r.id, r.chrom, r.pos, r.info)) for r in vcf.merged_inversions(df, 4).collect())
    assert got == expected


def test_stacked_inversions_meet_in_proportion(spark):
    """100,000 records on 500 places of one contig: all against all would be 5 * 10^9 pairs."""
    df = spark.range(100_000).select(F.concat(F.lit("v"), "id").alias("id"), F.lit("x").alias("chrom"), (F.col("id") % 500).cast("int").alias("pos"), F.lit("A").alias("ref"), F.concat(F.lit("SVTYPE=INV;END="), F.col("id") % 500 + 1000).alias("info"))
    assert sorted(r.id for r in vcf.merged_inversions(df, 250).collect()) == ["v0"]


def test_pairs_of_one_name_are_told_apart(spark):
    """Each row of pairs that fits a junction counts; where both orders of its reads fit, the first read at the first breakend."""
    pair = lambda name, pos, fwd2=False: ("s", name, 300, 0, pos, pos + 50, True, 0, pos + 500, pos + 550, fwd2, 60, 60)
    pairs = spark.createDataFrame([pair("a", 100), pair("a", 120), pair("b", 110)], "sample string, qname string, pp_max int, tid1 int, pos1 int, end1 int, fwd1 boolean, tid2 int, pos2 int, end2 int, fwd2 boolean, mapq1 int, mapq2 int")
    j = spark.createDataFrame([("e", 1, 0, 200, 240, 1, 0, 560, 600, 2, 219, 579)], "event string, junction int, b_tid1 int, b_begin1 int, b_end1 int, b_state1 int, b_tid2 int, b_begin2 int, b_end2 int, b_state2 int, c1 int, c2 int")
    shares = spark.createDataFrame([("s", 190, 0.5)], "sample string, size long, share double")
    got = sorted((r.qname, r.alt_size, r.alt_pair) for r in support.alt_pairs(j, pairs, shares).collect())
    assert got == [("a", 190, 0.5), ("a", 190, 0.5), ("b", 190, 0.5)]
    both = pairs.where("qname = 'b'").withColumns({"fwd2": F.lit(True), "pos2": F.lit(120), "end2": F.lit(170)})
    near = j.withColumns({"b_state2": F.lit(1), "b_begin2": F.lit(200), "b_end2": F.lit(240), "c2": F.lit(229)})
    assert [r.alt_size for r in support.alt_pairs(near, both, shares).collect()] == [(219 - 110) + (229 - 120)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_a_cut_are_worked_out_once(spark):
    """Not anew for each operation of the path; paths with repeated operations and empty cuts come out right."""
    df = spark.createDataFrame([("3S5M2D4M1I6M2S", "x"), ("4M4M2I0D3I5M", "x"), ("", "x")], "c string, name string").withColumn("path", cigar.parse(F.col("c")))
    cut = df.select("c", cigar.text(cigar.limited_to_read(F.col("path"), F.length("name") + 3, F.ascii("name") - 107)).alias("r"), cigar.text(cigar.matchified(F.col("path"))).alias("m"))
    assert plan(cut).count("length(name") == 1 and plan(cut).count("ascii(name") == 1
    assert [(r.r, r.m) for r in cut.collect()] == [("4M2D4M1I", "8M2D4M1I8M"), ("4M5I", "8M5I5M"), ("", "")]


FLAGGED = "qname string, flag int, sample int, tid int, pos0 int, cigar string, sa string"
CONTIGS = [(0, "c0", 5000), (1, "c1", 5000)]


def test_paths_of_indels_are_parsed_once(spark):
    """The test for an indel does not parse the path again below the step that takes it apart."""
    reads = R.with_flags(spark.createDataFrame([("a", 0, 0, 0, 100, "5S40M9D20M12I3D30M", None), ("b", 0, 0, 0, 100, "40M3D20M", None), ("c", 0, 0, 0, 100, "10I40M", None)], FLAGGED))
    found = observations.from_indels(reads, spark.createDataFrame(CONTIGS, "tid int, label string, length int"))
    assert plan(found).count("regexp_extract_all") == 2
    assert sorted((r.qname, r.bp1_state, r.bp1_begin, r.bp2_begin) for r in found.collect()) == [("a", 1, 120, 129), ("a", 1, 149, 152), ("c", 3, 80, 80)]


def test_split_tags_are_taken_apart_once(spark):
    """The tests of a split segment do not take the tag apart again; malformed segments raise with their text."""
    row = lambda name, sa: (name, 0, 0, 0, 100, "40M20S", sa)
    contigs = spark.createDataFrame(CONTIGS, "tid int, label string, length int")
    reads = lambda *rows: R.with_flags(spark.createDataFrame(list(rows), FLAGGED))
    found = observations.from_splits(reads(row("a", "c1,301,-,40S20M,60,0;"), row("b", "c1,301,-,40S20M,3,0;"), row("c", "c1,301,-,40S20M,60,0;c0,301,-,40S20M,60,0;"), row("d", None)), contigs)
    assert plan(found).count("split(sa") == 1
    assert [(r.qname, r.bp1_state, r.bp1_begin, r.bp2_state, r.bp2_tid, r.bp2_begin) for r in found.collect()] == [("a", 1, 120, 2, 1, 280)]
    with pytest.raises(Exception, match="split alignment segment: c1,301,-,40S20M"):
        observations.from_splits(reads(row("e", "c1,301,-,40S20M;")), contigs).collect()


def test_depth_of_reads_by_place_alone(spark):
    """Each read is judged by its own place, equal and nameless ones too, and enters the join once."""
    rng = random.Random(5)
    reads = [(rng.choice([None, "a", "b"]), rng.choice([0, 1, None]), rng.randrange(9000)) for _ in range(400)]
    windows = [(rng.randrange(2), b := rng.randrange(9000), b + rng.choice([1, 30, 2500]), rng.choice([1.0, 30.0])) for _ in range(20)]
    df = spark.createDataFrame(reads, "qname string, tid int, pos0 int").withColumns({"sample": F.lit(0), "flag": F.lit(0)})
    limits = spark.createDataFrame([(0, 1.0), (1, 2.0)], "tid int, depth double")
    out = R.depth_filtered(df, spark.createDataFrame(windows, "tid int, begin int, end int, depth double"), limits)
    deep = lambda r: any(w[0] == r[1] and w[1] <= r[2] < w[2] and w[3] > 12 * (w[0] + 1) for w in windows)
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.qname, r.tid, r.pos0, r.is_deep)) for r in out.collect()) == sorted(key((*r, deep(r))) for r in reads)
    assert out.columns == [*df.columns, "is_deep"]


def test_ranges_find_their_hulls_without_an_overlap_join(spark, monkeypatch):
    """The graph's intervals are put into their islands by an equi-join, whether islands lie in one block of places or in several."""
    rng = random.Random(7)
    rows = [(k, rng.randrange(2), b := rng.choice([0, intervals.BLOCK, 3 * intervals.BLOCK]) + rng.randrange(-300, 3000), b + rng.choice([5, 40, 400])) for k in range(300)]
    rows += [(300, 0, 2 * intervals.BLOCK, 3 * intervals.BLOCK + 100), (301, 1, intervals.BLOCK - 9, intervals.BLOCK + 9)]
    df = spark.createDataFrame(rows, "k long, tid int, begin long, end long")
    expected = intervals.overlap_join(df, intervals.merged(df).toDF("h_tid", "island", "h_begin", "h_end", "n"), right_cols=("h_tid", "h_begin", "h_end"))
    names = ["k", "tid", "begin", "end", "island", "h_begin", "h_end"]
    assert sorted(map(tuple, intervals.with_hulls(df).select(names).collect())) == sorted(map(tuple, expected.select(names).collect()))
    monkeypatch.delattr(intervals, "overlap_join")
    end = lambda b: F.struct(F.col("tid"), F.col("begin").alias("begin"), (F.col("begin") + b).alias("end"))
    nodes, edges = graph.merge(df.select(end(50).alias("a"), end(20).alias("b"), F.lit(3).cast("long").alias("w")))
    assert nodes.count() > 0 and edges.count() > 0


def test_reads_of_few_ids_are_not_dealt_by_id(spark):
    """All reads of an id would else be one task's; tags hold every kind once, in order."""
    keys = "sample int, qname string, read_no int, tid int, pos0 int"
    reads = spark.createDataFrame([(0, "a", 1, 0, 0), (0, "b", 1, 0, 0), (0, "c", 1, 0, 0)], keys)
    support_ = spark.createDataFrame([(0, q, 1, 0, 0, sv, kind) for q, sv, kind in [("a", "V3", "SR"), ("a", "V3", "PR"), ("a", "V3", "PR"), ("a", "V12", "SR"), ("b", "V7", None), ("b", None, "PR"), ("c", "V9", "PR")]], f"{keys}, sv string, kind string")
    found = vcf.reads_of(vcf.supporting_reads(reads, support_), spark.createDataFrame([("V3",), ("V12",), ("V7",)], "id string"))
    assert sorted((r.qname, r.zm) for r in found.collect()) == [("a", "V12|SR,V3|PR|SR"), ("b", "V7|")]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_edges_are_read_once_for_degrees(spark):
    edges = spark.createDataFrame([(1, 2, 5, 6), (2, 2, 3, 3), (1, 3, 0, 4)], "n1 long, n2 long, count_fwd long, count_rev long")
    out = graph.degrees(edges)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 5), (2, 2, 9), (3, 1, 4)]
    assert plan(out).count("LogicalRDD") == 1


def test_tables_are_dealt_to_tasks_by_their_size(spark):
    df = spark.range(4_000_000).withColumn("b", F.col("id") % 7)
    parts = partitioning.spread(df, "id").rdd.getNumPartitions()
    assert parts >= 4 and partitioning.spread(df.unionAll(df), "id").rdd.getNumPartitions() >= 2 * parts - 1
    unknown = spark.createDataFrame([(1,)], "id long")
    assert partitioning.spread(unknown, "id").rdd.getNumPartitions() == unknown.rdd.getNumPartitions()
    assert partitioning.spread(spark.range(10), "id").rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()
