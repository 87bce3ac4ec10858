"""The breakend graph: nodes and directed edge counts as tables, merged by thresholded overlap.

Nodes are (locus, node, tid, begin, end); edges are (locus, n1, n2, w), one row for each direction, w its summed
evidence. Observations become edges between intervals; overlapping intervals whose edges' evidence together
reaches the threshold in either direction are one node, by islands; what stays below it is cleaned away. The
merge looks at total evidence at once, so unlike a read-by-read merge it does not depend on the order of reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals
from .partitioning import spread

#: Weight of an observation times the least number of observations.
THRESHOLD = 9
MAX_HUB_DEGREE = 10


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='helixloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def checkpointed(df: DataFrame, name: str = "graph") -> DataFrame:
    """df written to the shared folder of the session and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by checkpointed(), once nothing lazy refers to it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node and component (the least node it is connected to), by alternating stars; self edges name lone nodes."""
    lone = edges.select(F.col(a).alias("node")).unionAll(edges.select(F.col(b).alias("node"))).distinct()
    links = checkpointed(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionAll(low.select(F.col("m").alias("a"), "b")).distinct()
        after = checkpointed(small)
        forget(links)
        links = after
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return lone.join(links.select(F.col("b").alias("node"), F.col("a").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("component"))


def merge(protos: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of proto edges (a, b: structs of tid, begin, end; w).

    1. An interval's evidence is the sum of what its edges carry, out and in. 2. Overlapping intervals are
    islands; an island's peak evidence (its places' summed weights) decides whether it is signal. 3. Intervals of
    a signal island are one node, the hull; others stay as they are, and are noise. 4. Edge counts add up over
    merged nodes. 5. Loci are the connected components.
    """
    ends = protos.select(F.col("a.tid").alias("tid"), F.col("a.begin").alias("begin"), F.col("a.end").alias("end"), "w").unionAll(protos.select(F.col("b.tid").alias("tid"), F.col("b.begin").alias("begin"), F.col("b.end").alias("end"), F.lit(0).cast("long").alias("w")))
    spans = ends.groupBy("tid", "begin", "end").agg(F.sum("w").alias("w"))
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(checkpointed(df, "spans"))
        return kept[-1]

    # islands by blocks of places; each interval lies in just one island's hull
    numbered = keep(intervals.with_hulls(spans, stored=keep))
    peaks = intervals.region_peak(numbered.where("w > 0"), ("tid", "island"), weight=F.col("w"))
    named = (
        numbered.join(peaks, ["tid", "island"], "left")
        .withColumn("signal", F.coalesce(F.col("peak") >= threshold, F.lit(False)))
        .select(
            "tid", "begin", "end",
            F.when(F.col("signal"), F.col("h_begin")).otherwise(F.col("begin")).alias("n_begin"), F.when(F.col("signal"), F.col("h_end")).otherwise(F.col("end")).alias("n_end"),
        )
    )
    node = checkpointed(named.withColumn("id", F.xxhash64("tid", "n_begin", "n_end")), "nodes")
    for df in kept:
        forget(df)
    at = lambda k: node.select(F.struct("tid", "begin", "end").alias(k), F.col("id").alias(f"{k}_id"))
    edges = protos.join(at("a"), "a").join(at("b"), "b").groupBy(F.col("a_id").alias("n1"), F.col("b_id").alias("n2")).agg(F.sum("w").alias("w"))
    edges = checkpointed(edges, "edges")
    parts = checkpointed(connected_components(edges, "n1", "n2"), "parts")  # read for the nodes and for the edges
    nodes = node.select("id", "tid", F.col("n_begin").alias("begin"), F.col("n_end").alias("end")).distinct().join(parts, F.col("id") == F.col("node")).select(F.col("component").alias("locus"), "node", "tid", "begin", "end")
    return nodes, edges.join(parts.select(F.col("node").alias("n1"), F.col("component").alias("locus")), "n1").select("locus", "n1", "n2", "w")


def merge_sets(*sets: DataFrame) -> DataFrame:
    """Proto edges of several graphs as one; their union merges once."""
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out


def paired(edges: DataFrame) -> DataFrame:
    """One row for each linked pair, n1 <= n2, with the counts of both directions."""
    forward = F.when(F.col("n1") <= F.col("n2"), F.col("w")).otherwise(0)
    back = F.when(F.col("n1") > F.col("n2"), F.col("w")).otherwise(0)
    sides = edges.select("locus", F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2"), forward.alias("_f"), back.alias("_b"))
    out = spread(sides, "locus", "n1", "n2").groupBy("locus", "n1", "n2").agg(F.sum("_f").alias("count_fwd"), F.sum("_b").alias("count_rev"))
    return out.withColumn("count_rev", F.when(F.col("n1") == F.col("n2"), F.col("count_fwd")).otherwise(F.col("count_rev")))


def cleaned(edges: DataFrame, threshold: int = THRESHOLD, region: Column | None = None) -> DataFrame:
    """Directed counts below the threshold as zero; pairs with both zero go. region: only these rows are cleaned."""
    here = F.lit(True) if region is None else region
    cut = lambda c: F.when(here & (F.col(c) < threshold), 0).otherwise(F.col(c)).cast("long").alias(c)
    keep = [c for c in edges.columns if c not in ("count_fwd", "count_rev")]
    return edges.select(*keep, cut("count_fwd"), cut("count_rev")).where("count_fwd > 0 OR count_rev > 0")


def cleaned_total(edges: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """How much evidence cleaning removes."""
    gone = lambda c: F.sum(F.when(F.col(c) < threshold, F.col(c)).otherwise(0))
    return edges.agg((gone("count_fwd") + gone("count_rev")).alias("cleaned"))


def without_empty_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.col("n1").alias("node")).unionAll(edges.select(F.col("n2").alias("node")))
    return nodes.join(used, "node", "left_semi")


def bidirectional(threshold: int = THRESHOLD) -> Column:
    return (F.col("count_fwd") >= threshold) & (F.col("count_rev") >= threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (linked nodes, itself included) and observations (counts out of it), from paired edges."""
    end = lambda n, w: F.struct(F.col(n).alias("node"), F.col(w).alias("w"))
    ends = F.when(F.col("n1") == F.col("n2"), F.array(end("n1", "count_fwd"))).otherwise(F.array(end("n1", "count_fwd"), end("n2", "count_rev")))
    out = edges.select(F.explode(ends).alias("e")).select("e.node", "e.w")  # edges are read once
    return out.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("observations"))


def without_hub_edges(edges: DataFrame, most: int = MAX_HUB_DEGREE) -> DataFrame:
    """Edges but those between two nodes that both have more than `most` edges. Only hubs are joined back."""
    hubs = degrees(edges).where(F.col("degree") > most).select("node")
    a, b = hubs.select(F.col("node").alias("n1"), F.lit(True).alias("_a")), hubs.select(F.col("node").alias("n2"), F.lit(True).alias("_b"))
    return edges.join(a, "n1", "left").join(b, "n2", "left").where("_a IS NULL OR _b IS NULL").drop("_a", "_b")


def noise_nodes(edges: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node and is_noise: no edge of it reaches the threshold in either direction."""
    ends = edges.select(F.col("n1").alias("node"), "count_fwd", "count_rev").unionAll(edges.select(F.col("n2").alias("node"), "count_fwd", "count_rev"))
    return ends.groupBy("node").agg((F.max(F.greatest("count_fwd", "count_rev")) < threshold).alias("is_noise"))


def isolated(edges: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node and is_skipped for nodes with a self edge: not (one or two bidirectional edges and at most four others)."""
    ends = edges.where("n1 <> n2").select(F.col("n1").alias("node"), bidirectional(threshold).alias("both")).unionAll(edges.where("n1 <> n2").select(F.col("n2").alias("node"), bidirectional(threshold).alias("both")))
    counted = ends.groupBy("node").agg(F.count_if("both").alias("n_both"), F.count_if(~F.col("both")).alias("n_other"))
    own = edges.where("n1 = n2").select(F.col("n1").alias("node"))
    out = own.join(counted, "node", "left").fillna(0, ["n_both", "n_other"])
    return out.withColumn("is_skipped", ~(F.col("n_both").between(1, 2) & (F.col("n_other") <= 4)))


def signal_neighbours(nodes: DataFrame, edges: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of different signal nodes (node, other) that overlap: what a merge would join next. Empty after merge()."""
    signal = noise_nodes(edges, threshold).where("NOT is_noise").select("node")
    own = nodes.join(signal, "node")
    other = own.select(F.col("node").alias("other"), F.col("tid").alias("o_tid"), F.col("begin").alias("o_begin"), F.col("end").alias("o_end"))
    return intervals.overlap_join(own, other, right_cols=("o_tid", "o_begin", "o_end")).where("node < other").select("node", "other")


def checks(nodes: DataFrame, edges: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Faults of a graph, as rows of (fault, node); none in a valid one."""
    w = Window.partitionBy("tid").orderBy("begin", "end")
    signal = nodes.join(noise_nodes(edges, threshold).where("NOT is_noise"), "node")
    overlap = signal.withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("begin < _before").select(F.lit("signal nodes overlap").alias("fault"), "node")
    lost = edges.select(F.explode(F.array("n1", "n2")).alias("node")).distinct().join(nodes, "node", "left_anti").select(F.lit("edge without node").alias("fault"), "node")
    empty = nodes.where("begin >= end").select(F.lit("empty interval").alias("fault"), "node")
    alone = nodes.join(edges.select(F.explode(F.array("n1", "n2")).alias("node")), "node", "left_anti").select(F.lit("node without edge").alias("fault"), "node")
    return overlap.unionAll(lost).unionAll(empty).unionAll(alone)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals of the whole graph."""
    n = nodes.agg(F.countDistinct("locus").alias("loci"), F.count("*").alias("nodes"), F.sum(F.col("end") - F.col("begin")).alias("bases"), F.max(F.col("end") - F.col("begin")).alias("widest"))
    e = edges.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("n1") == F.col("n2")).alias("self_edges"),
        F.sum((F.col("count_fwd") > 0).cast("long") + ((F.col("count_rev") > 0) & (F.col("n1") != F.col("n2"))).cast("long")).alias("directed_edges"),
        F.sum(F.col("count_fwd") + F.when(F.col("n1") == F.col("n2"), 0).otherwise(F.col("count_rev"))).alias("evidence"),
    )
    return n.join(F.broadcast(e), F.lit(True))  # one row each


def locus_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node, edge and region totals and maxima of each locus."""
    n = nodes.groupBy("locus").agg(F.count("*").alias("nodes"), F.sum(F.col("end") - F.col("begin")).alias("bases"), F.max(F.col("end") - F.col("begin")).alias("widest"))
    both = F.col("count_fwd") + F.when(F.col("n1") == F.col("n2"), 0).otherwise(F.col("count_rev"))
    e = edges.groupBy("locus").agg(F.count("*").alias("edges"), F.sum(both).alias("evidence"), F.max(both).alias("most_evidence"))
    return n.join(e, "locus", "left").fillna(0, ["edges", "evidence", "most_evidence"])


def degree_histogram(edges: DataFrame, most: int = 9) -> DataFrame:
    return degrees(edges).groupBy(F.least("degree", F.lit(most).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def observation_histogram(edges: DataFrame, most: int = 29) -> DataFrame:
    return degrees(edges).groupBy(F.least("observations", F.lit(most).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def binned(edges: DataFrame, bins: int, order=("n1", "n2")) -> DataFrame:
    """Adds bin: ranges of edges, in order, of about equal evidence. Ranges are summed apart and then offset."""
    w = F.col("count_fwd") + F.col("count_rev")
    part = edges.repartitionByRange(*order).withColumn("_w", w).withColumn("_part", F.spark_partition_id())
    part = checkpointed(part, "binned")
    sums = part.groupBy("_part").agg(F.sum("_w").alias("_s"))
    offset = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    total = F.sum("_s").over(Window.partitionBy())
    offset = offset.withColumn("_total", total)
    own = F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = part.join(F.broadcast(offset.select("_part", "_before", "_total")), "_part").withColumn("_at", F.col("_before") + F.coalesce(own, F.lit(0)))
    return out.withColumn("bin", F.least(F.floor(F.col("_at") * bins / F.col("_total")).cast("int"), F.lit(bins - 1))).drop("_w", "_part", "_before", "_total", "_at")


def dealt(edges: DataFrame, bins: int) -> DataFrame:
    """Adds bin: a fixed deal of edges to bins, which spreads neighbours."""
    return edges.withColumn("bin", F.pmod(F.xxhash64("locus", "n1", "n2"), F.lit(bins)).cast("int"))


def of_locus(edges: DataFrame, locus: int, pair: tuple[int, int] | None = None) -> DataFrame:
    out = edges.where(F.col("locus") == locus)
    return out if pair is None else out.where((F.col("n1") == min(pair)) & (F.col("n2") == max(pair)))


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line for each node, with its edges, in order of place."""
    out = edges.select(F.col("n1").alias("node"), F.concat_ws(":", "n2", "count_fwd", "count_rev").alias("_t")).unionAll(edges.where("n1 <> n2").select(F.col("n2").alias("node"), F.concat_ws(":", "n1", "count_rev", "count_fwd").alias("_t")))
    lists = out.groupBy("node").agg(F.array_sort(F.collect_list("_t")).alias("_links"))
    line = F.concat(F.lit("locus "), "locus", F.lit(" node "), "node", F.lit(" "), "tid", F.lit(":["), "begin", F.lit(","), "end", F.lit(") -> "), F.array_join("_links", " "))
    return nodes.join(lists, "node", "left").orderBy("tid", "begin", "end").select(line.alias("line"))


def in_region(nodes: DataFrame, tid: int, begin: int, end: int) -> DataFrame:
    return nodes.where((F.col("tid") == tid) & (F.col("begin") < end) & (F.col("end") > begin))
