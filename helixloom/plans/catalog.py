"""Driver queries: each operator on the star-schema tables through its column parameters, with the same result as SQL.

Adapters stand in for alignments: events are intervals (tid = user, begin = seconds, end by value), line items are
reads, edges and fragments, orders are variant records, nations are contigs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, prob, seq
from ..operators import candidates, graph, intervals, partitioning, reads, scoring, stats, vcf

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tid"), begin.alias("begin"), "event_type", "value")
    return e.withColumn("end", F.col("begin") + 1 + F.floor(F.col("value") * 60).cast("long"))


SPANS = """s AS (SELECT event_id, user_id AS tid, date_diff('second', TIMESTAMP '2024-01-01', ts) AS "begin",
  date_diff('second', TIMESTAMP '2024-01-01', ts) + 1 + floor(value * 60)::BIGINT AS "end", event_type, value FROM events)"""


@query(f"""WITH {SPANS} SELECT a.event_id AS a_id, b.event_id AS b_id FROM s a JOIN s b
  ON a.tid = b.tid AND a."begin" < b."end" AND b."begin" < a."end" AND a.event_id < b.event_id""")
def interval_overlap_pairs(spark, sf_dir):
    s = spans(spark, sf_dir)
    a = s.select(F.col("event_id").alias("a_id"), "tid", "begin", "end")
    b = s.select(F.col("event_id").alias("b_id"), F.col("tid").alias("t2"), F.col("begin").alias("b2"), F.col("end").alias("e2"))
    return intervals.overlap_join(a, b, right_cols=("t2", "b2", "e2")).where("a_id < b_id").select("a_id", "b_id")


_SIDES = """SELECT a.event_id FROM s a WHERE a.event_type = 'error' AND {how} EXISTS (
  SELECT 1 FROM s b WHERE b.event_type = 'purchase' AND a.tid = b.tid AND a."begin" < b."end" AND b."begin" < a."end")"""


def _side(spark, sf_dir, how):
    s = spans(spark, sf_dir)
    a = s.where("event_type = 'error'").select("event_id", "tid", "begin", "end")
    return intervals.overlap_join(a, s.where("event_type = 'purchase'").select("tid", "begin", "end"), how).select("event_id")


@query(f"WITH {SPANS} {_SIDES.format(how='')}")
def interval_semi_join(spark, sf_dir):
    return _side(spark, sf_dir, "left_semi")


@query(f"WITH {SPANS} {_SIDES.format(how='NOT')}")
def interval_anti_join(spark, sf_dir):
    return _side(spark, sf_dir, "left_anti")


_ISLANDS = """, m AS (SELECT *, max("end") OVER (PARTITION BY tid ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR "begin" {op} before THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT tid, (k - 1)::BIGINT AS island, min("begin") AS "begin", max("end") AS "end", count(*) AS n FROM g GROUP BY tid, k"""


@query(f"WITH {SPANS} {_ISLANDS.format(op='>=')}")
def interval_islands(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir))


@query(f"WITH {SPANS} {_ISLANDS.format(op='>')}")
def region_tracker(spark, sf_dir):
    return intervals.merged(spans(spark, sf_dir), touching=True)


_STEPS = """, e AS (SELECT tid, "begin" AS pos, 1 AS d FROM s UNION ALL SELECT tid, "end", -1 FROM s), c AS (SELECT tid, pos, sum(d) AS d FROM e GROUP BY tid, pos),
  r AS (SELECT tid, pos AS "begin", lead(pos) OVER (PARTITION BY tid ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY tid ORDER BY pos) AS depth FROM c)"""


@query(f"""WITH {SPANS} {_STEPS} SELECT tid, "begin", "end", depth::BIGINT AS depth FROM r WHERE depth > 0 AND "end" IS NOT NULL""")
def coverage_depth(spark, sf_dir):
    return intervals.coverage(spans(spark, sf_dir))


@query(f"""WITH {SPANS} {_STEPS} SELECT tid, max(depth)::BIGINT AS peak FROM r GROUP BY tid""")
def coverage_peak(spark, sf_dir):
    return intervals.region_peak(spans(spark, sf_dir))


@query(f"""WITH {SPANS} SELECT event_id, ("begin" + (greatest("end" - "begin", 1) - 1) // 2)::BIGINT AS center FROM s""")
def interval_center(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", intervals.center(F.col("begin"), F.col("end")).alias("center"))


@query(f"""WITH {SPANS}, w AS (SELECT tid, count(*) OVER (PARTITION BY tid) AS n, "begin", lead("begin", 4) OVER (PARTITION BY tid ORDER BY "begin") AS ahead,
  max("begin") OVER (PARTITION BY tid) - min("begin") OVER (PARTITION BY tid) AS whole FROM s) SELECT tid, min(CASE WHEN n <= 4 THEN whole ELSE ahead - "begin" END)::BIGINT AS min_span FROM w GROUP BY tid""")
def min_span_window(spark, sf_dir):
    return intervals.minimum_span(spans(spark, sf_dir), ["tid"], "begin")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sum(CASE WHEN l_tax > 0 THEN l_quantity::BIGINT END) OVER w::BIGINT AS window_sum, count(CASE WHEN l_tax > 0 THEN 1 END) OVER w AS window_n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def window_average(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("long")))
    return intervals.window_average(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "v", 4).select("l_orderkey", "l_linenumber", "l_partkey", "window_sum", "window_n")


@query("""WITH r AS (SELECT event_id, user_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events)
  SELECT event_id, recent, max(recent) OVER (PARTITION BY user_id ORDER BY event_id) AS recent_max FROM r""")
def circular_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return intervals.circular_count(e, ["user_id"], ["event_id"], F.col("event_type") == "error", 10).select("event_id", "recent", "recent_max")


@query("""WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM m""")
def adjacent_groups(spark, sf_dir):
    return intervals.adjacent_groups(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type"]).select("event_id", "run")


def sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample"), F.floor(F.col("l_extendedprice") / 10).cast("long").alias("size"))


HIST = """z AS (SELECT l_returnflag AS sample, floor(l_extendedprice / 10)::BIGINT AS v FROM lineitem),
  h AS (SELECT sample, CASE WHEN v > 1000 THEN v - v % (10 ^ (length(v::VARCHAR) - 3))::BIGINT ELSE v END AS size, count(*) AS n FROM z GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY size)::BIGINT AS below, sum(n) OVER (PARTITION BY sample)::BIGINT AS total FROM h)"""


@query(f"WITH {HIST} SELECT sample, size, n FROM h")
def size_histogram(spark, sf_dir):
    return stats.size_histogram(sizes(spark, sf_dir), ["sample"], "size")


@query(f"WITH {HIST} SELECT sample, size, n, below, total FROM c")
def size_cdf(spark, sf_dir):
    return stats.size_cdf(size_histogram(spark, sf_dir), ["sample"])


_PS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(f"WITH {HIST} SELECT sample, min(size) AS size, p::DOUBLE AS p FROM c, (SELECT unnest([{', '.join(map(str, _PS))}]) AS p) WHERE round_even(below * 1000 / total, 0) >= ceil(p * 1000 - 1e-9) GROUP BY sample, p")
def size_quantiles(spark, sf_dir):
    return stats.quantiles(size_cdf(spark, sf_dir), ["sample"], _PS)


@query(f"WITH {HIST}, q AS (SELECT sample, min(size) AS lim FROM c WHERE round_even(below * 1000 / total, 0) >= 900 GROUP BY sample) SELECT h.sample, size, n FROM h JOIN q ON h.sample = q.sample WHERE size <= lim")
def trimmed_histogram(spark, sf_dir):
    return stats.trimmed(size_histogram(spark, sf_dir), ["sample"], 0.9)


@query(f"WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY abs(size - 3000), size) AS k FROM c) SELECT sample, round(sum(n) / (any_value(total) * (max(size) - min(size) + 1)), 9) AS density FROM r WHERE k <= 5 GROUP BY sample")
def nearest_density(spark, sf_dir):
    return stats.nearest_density(size_histogram(spark, sf_dir), ["sample"], 3000).withColumn("density", F.round("density", 9))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag)::BIGINT AS total FROM c)
  SELECT l_returnflag, l_linestatus, n, total, total >= 100 AND n >= total * 0.9 AS consensus FROM t QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus DESC) = 1""")
def orientation_consensus(spark, sf_dir):
    return stats.orientation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus")


@query("""WITH b AS (SELECT event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS k, event_type FROM events)
  SELECT event_id FROM (SELECT *, avg((value >= 300)::INT) OVER (PARTITION BY event_type, k) AS bad FROM b) WHERE bad < 0.05""")
def outlier_blocks(spark, sf_dir):
    return stats.without_outlier_blocks(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "value", 50, 300, 0.05).select("event_id")


@query("WITH d AS (SELECT o_custkey, o_orderstatus, count(*) - 1 AS depth FROM orders GROUP BY 1, 2) SELECT o_orderstatus, coalesce(median(CASE WHEN depth > 0 THEN depth END), 0)::DOUBLE AS median_depth FROM d GROUP BY 1")
def nonzero_median(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.count("*") - 1).alias("depth"))
    return stats.median_depth(d, ["o_orderstatus"], "depth")


@query("SELECT s_nationkey AS label, sum(s_suppkey)::BIGINT AS depth FROM supplier GROUP BY 1")
def merged_depths(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("depth"))
    return stats.merged_depths(s, "label", "depth")


@query("""WITH c AS (SELECT l_returnflag AS sample, count(*) AS total, count(*) FILTER (l_tax > 0.06) AS anom, count(*) FILTER (l_discount > 0.08) AS split,
  count(*) FILTER (l_tax > 0.06 AND l_discount > 0.08) AS b, count(*) FILTER (l_quantity > 40) AS assm, count(*) FILTER (l_linenumber > 5) AS remote FROM lineitem GROUP BY 1)
  SELECT sample, round((anom + split - b + 10) / (total + 1000), 9) AS anomalous_rate, round((assm + 10) / (total + 1000), 9) AS assembly_rate, round((remote + 100) / (total + 10000), 9) AS remote_rate FROM c""")
def noise_rate(spark, sf_dir):
    n = lambda c: F.count_if(F.expr(c))
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("sample")).agg(F.count("*").alias("total"), n("l_tax > 0.06").alias("anom"), n("l_discount > 0.08").alias("split"), n("l_tax > 0.06 AND l_discount > 0.08").alias("anom_and_split"), n("l_quantity > 40").alias("assm"), n("l_linenumber > 5").alias("remote"))
    return stats.noise_rates(c).select("sample", *[F.round(x, 9).alias(x) for x in ("anomalous_rate", "assembly_rate", "remote_rate")])


@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 25")
def reservoir_sample(spark, sf_dir):
    return stats.reservoir(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", 25).select("o_orderkey", "o_orderstatus")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 4) AS variance, round(stddev_samp(l_quantity), 5) AS deviation, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem GROUP BY 1")
def stream_statistics(spark, sf_dir):
    out = stats.stream_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("deviation", 5).alias("deviation"), "least", "greatest")


@query("SELECT l_returnflag, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1")
def rms_mapq(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.root_mean_square(F.col("l_quantity")), 6).alias("rms"))


@query("WITH v AS (SELECT l_suppkey, ln((l_discount + 0.01) / 10) * l_linenumber AS x FROM lineitem), t AS (SELECT *, max(x) OVER (PARTITION BY l_suppkey) AS top FROM v) SELECT l_suppkey, round(any_value(top) + ln(sum(exp(x - top))), 6) AS log_sum FROM t GROUP BY l_suppkey")
def log_sum_exp(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.log((F.col("l_discount") + 0.01) / 10) * F.col("l_linenumber")).alias("x"))
    return stats.log_sum(v, ["l_suppkey"], "x").withColumn("log_sum", F.round("log_sum", 6))


@query("SELECT p_partkey, floor(-10 * log10(p_size / 51.0) + 0.5)::INT AS q, round(10 ^ (-p_size / 10.0), 9) AS e, round((10 ^ (-p_size / 10.0)) * (1 - 0.001 / 3) + (1 - 10 ^ (-p_size / 10.0)) * 0.001, 9) AS snp FROM part")
def phred_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", prob.phred(F.col("p_size") / 51.0).alias("q"), F.round(prob.error_probability(F.col("p_size")), 9).alias("e"), F.round(prob.snp_adjusted_error(F.col("p_size"), 0.001), 9).alias("snp"))


@query("SELECT l_partkey, o FROM (SELECT l_partkey, l_orderkey AS o, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def best_record(spark, sf_dir):
    return stats.best_of_group(table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_suppkey").select("l_partkey", F.col("l_orderkey").alias("o"))


@query("SELECT least(l_quantity::BIGINT, 9) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def binned_histogram(spark, sf_dir):
    return stats.clipped_histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"), 9)


def alignments(spark, sf_dir):
    """Line items as reads: flags, places and paths by arithmetic on the keys."""
    l = table(spark, sf_dir, "lineitem")
    match = F.col("l_quantity").cast("int") + 40
    return l.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 4096).cast("int").alias("flag"), F.col("l_returnflag").alias("sample"),
        (F.col("l_suppkey") % 8).cast("int").alias("tid"), (F.col("l_partkey") * 10).cast("int").alias("pos0"), (F.col("l_linenumber") * 9 % 61).cast("int").alias("mapq"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), match.cast("string"), F.lit("M"), ((F.col("l_suppkey") % 12) + 1).cast("string"), F.lit("D20M")).alias("cigar"),
        F.when(F.col("l_discount") < 0.05, (F.col("l_suppkey") % 8)).otherwise((F.col("l_suppkey") + 1) % 8).cast("int").alias("mate_tid"), (F.col("l_partkey") * 10 + F.col("l_linenumber") * 60 - 200).cast("int").alias("mate_pos0"),
        (F.col("l_linenumber") * 60 - 200).cast("int").alias("tlen"), F.repeat(F.lit("A"), F.col("l_linenumber") + match + 20).alias("seq"), F.when(F.col("l_tax") > 0.06, F.lit("x")).alias("sa"), F.lit(None).cast("string").alias("mc"),
        F.lit(150).alias("pp_min"), F.lit(200).alias("pp_max"),
    )


ALIGNMENTS = """a AS (SELECT l_orderkey || '/' || l_linenumber AS qname, ((l_partkey * 7 + l_linenumber * 13) % 4096)::INT AS flag, l_returnflag AS sample, l_suppkey % 8 AS tid, l_partkey * 10 AS pos0, l_linenumber * 9 % 61 AS mapq,
  CASE WHEN l_discount < 0.05 THEN l_suppkey % 8 ELSE (l_suppkey + 1) % 8 END AS mate_tid, l_partkey * 10 + l_linenumber * 60 - 200 AS mate_pos0, l_linenumber * 60 - 200 AS tlen, l_tax > 0.06 AS split, l_suppkey % 12 + 1 AS del,
  l_linenumber, l_quantity::INT + 40 AS match FROM lineitem),
  f AS (SELECT *, (flag & 1) <> 0 AS paired, (flag & 4) <> 0 AS unmapped, (flag & 8) <> 0 AS mate_unmapped, (flag & 16) = 0 AS fwd, (flag & 32) = 0 AS mate_fwd,
    (flag & 512) <> 0 OR (flag & 1024) <> 0 OR (((flag & 2048) <> 0 OR (flag & 256) <> 0) AND NOT split) AS core FROM a),
  p AS (SELECT *, paired AND NOT unmapped AND NOT mate_unmapped AS pair FROM f),
  i AS (SELECT *, pair AND tid = mate_tid AND fwd <> mate_fwd AND (CASE WHEN fwd THEN pos0 ELSE mate_pos0 END) <= (CASE WHEN fwd THEN mate_pos0 ELSE pos0 END) AS innie,
    CASE WHEN tid <> mate_tid THEN 'DISTANT' WHEN tlen = 0 THEN 'UNKNOWN' WHEN abs(tlen) < 150 THEN 'COMPRESSED' WHEN abs(tlen) <= 200 THEN 'NORMAL' WHEN abs(tlen) < 800 THEN 'CLOSE' ELSE 'DISTANT' END AS cls FROM p),
  n AS (SELECT *, pair AND (NOT innie OR tlen = 0 OR abs(tlen) > 300 OR abs(tlen) < 150) AS odd FROM i),
  x AS (SELECT *, odd AND (NOT innie OR cls NOT IN ('NORMAL', 'COMPRESSED')) AS anom FROM n)"""


@query(f"WITH {ALIGNMENTS} SELECT qname, core, core OR unmapped AS lost, pair, innie, cls, odd, anom FROM x")
def read_classes(spark, sf_dir):
    r = reads.with_flags(alignments(spark, sf_dir))
    return r.select("qname", reads.core_filtered().alias("core"), reads.mapped_filtered().alias("lost"), reads.mapped_pair().alias("pair"), reads.innie().alias("innie"), reads.size_class().alias("cls"), reads.anomalous().alias("odd"), reads.non_compressed_anomalous().alias("anom"))


@query(f"""WITH {ALIGNMENTS}, e AS (SELECT *, del >= 8 AS indel, mapq >= 15 AS u FROM x WHERE NOT (core OR unmapped))
  SELECT sample, count(*) FILTER (NOT u) AS min_mapq, count(*) FILTER (u) AS total, count(*) FILTER (u AND NOT (anom OR split OR indel)) AS ignored, count(*) FILTER (u AND anom) AS anom, count(*) FILTER (u AND split) AS split,
  count(*) FILTER (u AND anom AND split) AS anom_and_split, count(*) FILTER (u AND indel) AS indel, count(*) FILTER (u AND indel) AS assm,
  count(*) FILTER (u AND pair AND (tid <> mate_tid OR abs(pos0 - mate_pos0) >= 10000)) AS remote, count(*) FILTER (u AND split AND ((flag & 2048) <> 0 OR (flag & 256) <> 0)) AS split_supp FROM e GROUP BY sample""")
def evidence_counters(spark, sf_dir):
    r = reads.with_flags(alignments(spark, sf_dir)).where(~reads.mapped_filtered())
    return reads.sample_counts(reads.evidence(r))


@query(f"WITH {ALIGNMENTS} SELECT qname, (l_linenumber + match + 20)::INT AS read_len, (match + del + 20)::INT AS ref_len, (match + 20)::INT AS matched, l_linenumber::INT AS lead, 0 AS trail, 1 AS indels FROM a")
def cigar_lengths(spark, sf_dir):
    p = alignments(spark, sf_dir).withColumn("path", cigar.parse(F.col("cigar")))
    c = F.col("path")
    return p.select("qname", cigar.read_length(c).alias("read_len"), cigar.ref_length(c).alias("ref_len"), cigar.matched_length(c).alias("matched"), cigar.clip_lead(c).alias("lead"), cigar.clip_trail(c).alias("trail"), cigar.indel_count(c).alias("indels"))


@query("""WITH RECURSIVE c AS (SELECT n_nationkey AS tid, n_name AS label, (n_nationkey + 1)::BIGINT * 7000001 AS length FROM nation), k AS (SELECT *, 1 + (length - 1) // 12000000 AS n FROM c),
  s AS (SELECT *, unnest(range(0, n)) AS segment FROM k) SELECT tid, label, segment, (segment * (length // n) + least(segment, length % n) + 1)::BIGINT AS "begin", ((segment + 1) * (length // n) + least(segment + 1, length % n))::BIGINT AS "end" FROM s""")
def contig_segments(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tid"), F.col("n_name").alias("label"), ((F.col("n_nationkey") + 1).cast("long") * 7000001).alias("length"))
    return partitioning.segments(c)


@query("""SELECT o_orderkey, n_name AS label, (o_custkey * 10)::BIGINT AS "begin", least(o_custkey * 10 + 500, 10000)::BIGINT AS "end" FROM orders JOIN nation ON n_nationkey = o_custkey % 25""")
def region_strings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.lit(10000).alias("length"), "n_nationkey")
    o = table(spark, sf_dir, "orders").join(n, F.col("n_nationkey") == F.col("o_custkey") % 25).select("o_orderkey", F.concat("label", F.lit(":"), (F.col("o_custkey") * 10 + 1).cast("string"), F.lit("-"), (F.col("o_custkey") * 10 + 500).cast("string")).alias("region"))
    return partitioning.regions(o, n).select("o_orderkey", "label", "begin", "end")


def links(spark, sf_dir):
    """Directed evidence between parts and suppliers, forward by quantity and back by line number."""
    l = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_partkey"), F.col("l_suppkey") + 100_000_000
    e = l.select(F.explode(F.array(F.struct(a.alias("n1"), b.alias("n2"), F.floor(F.col("l_quantity") / 5).cast("long").alias("w")), F.struct(b.alias("n1"), a.alias("n2"), F.col("l_linenumber").cast("long").alias("w")))).alias("e"))
    return e.select(F.lit(0).cast("long").alias("locus"), "e.n1", "e.n2", "e.w")


LINKS = "p AS (SELECT l_partkey AS n1, l_suppkey + 100000000 AS n2, sum(floor(l_quantity / 5)::BIGINT)::BIGINT AS count_fwd, sum(l_linenumber)::BIGINT AS count_rev FROM lineitem GROUP BY 1, 2)"
CLEAN = f"{LINKS}, e AS (SELECT n1, n2, CASE WHEN count_fwd < 9 THEN 0 ELSE count_fwd END::BIGINT AS count_fwd, CASE WHEN count_rev < 9 THEN 0 ELSE count_rev END::BIGINT AS count_rev FROM p WHERE count_fwd >= 9 OR count_rev >= 9)"
ENDS = "d AS (SELECT n1 AS node, count_fwd AS w, count_fwd, count_rev FROM {t} UNION ALL SELECT n2, count_rev, count_fwd, count_rev FROM {t})"


@query(f"WITH {LINKS} SELECT 0::BIGINT AS locus, * FROM p")
def edge_counts(spark, sf_dir):
    return graph.paired(links(spark, sf_dir))


@query(f"WITH {CLEAN} SELECT 0::BIGINT AS locus, * FROM e")
def edge_clean(spark, sf_dir):
    return graph.cleaned(edge_counts(spark, sf_dir))


@query(f"WITH {LINKS} SELECT (sum(CASE WHEN count_fwd < 9 THEN count_fwd ELSE 0 END) + sum(CASE WHEN count_rev < 9 THEN count_rev ELSE 0 END))::BIGINT AS cleaned FROM p")
def edge_cleaned_total(spark, sf_dir):
    return graph.cleaned_total(edge_counts(spark, sf_dir))


@query(f"WITH {LINKS} SELECT n1, n2 FROM p WHERE count_fwd >= 9 AND count_rev >= 9")
def bidirectional_edges(spark, sf_dir):
    return edge_counts(spark, sf_dir).where(graph.bidirectional()).select("n1", "n2")


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, h AS (SELECT node FROM d GROUP BY node HAVING count(*) > 30) SELECT n1, n2 FROM p WHERE NOT (n1 IN (SELECT node FROM h) AND n2 IN (SELECT node FROM h))")
def hub_filter(spark, sf_dir):
    return graph.without_hub_edges(edge_counts(spark, sf_dir), 30).select("n1", "n2")


@query(f"WITH {LINKS}, {ENDS.format(t='p')} SELECT node, max(greatest(count_fwd, count_rev)) < 9 AS is_noise FROM d GROUP BY node")
def node_noise(spark, sf_dir):
    return graph.noise_nodes(edge_counts(spark, sf_dir))


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, g AS (SELECT node, count(*) AS k FROM d GROUP BY node) SELECT least(k, 9) AS bin, count(*) AS n FROM g GROUP BY 1")
def degree_histogram(spark, sf_dir):
    return graph.degree_histogram(edge_counts(spark, sf_dir))


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, g AS (SELECT node, sum(w)::BIGINT AS k FROM d GROUP BY node) SELECT least(k, 29) AS bin, count(*) AS n FROM g GROUP BY 1")
def observation_histogram(spark, sf_dir):
    return graph.observation_histogram(edge_counts(spark, sf_dir))


def _nodes(edges):
    n = edges.select("locus", F.explode(F.array("n1", "n2")).alias("node")).distinct()
    return n.select("locus", "node", F.lit(0).alias("tid"), (F.col("node") * 100).alias("begin"), (F.col("node") * 100 + 10 + F.col("node") % 7).alias("end"))


_NODES = "n AS (SELECT DISTINCT node, 10 + node % 7 AS size FROM d)"


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, {_NODES} SELECT 1::BIGINT AS loci, (SELECT count(*) FROM n) AS nodes, (SELECT sum(size)::BIGINT FROM n) AS bases, (SELECT max(size) FROM n) AS widest, count(*) AS edges, 0::BIGINT AS self_edges, sum((count_fwd > 0)::INT + (count_rev > 0)::INT)::BIGINT AS directed_edges, sum(count_fwd + count_rev)::BIGINT AS evidence FROM p")
def graph_summary(spark, sf_dir):
    e = edge_counts(spark, sf_dir)
    return graph.summary(_nodes(e), e)


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, {_NODES} SELECT 0::BIGINT AS locus, (SELECT count(*) FROM n) AS nodes, (SELECT sum(size)::BIGINT FROM n) AS bases, (SELECT max(size) FROM n) AS widest, count(*) AS edges, sum(count_fwd + count_rev)::BIGINT AS evidence, max(count_fwd + count_rev) AS most_evidence FROM p")
def locus_summary(spark, sf_dir):
    e = edge_counts(spark, sf_dir)
    return graph.locus_summary(_nodes(e), e)


@query(f"""WITH {LINKS}, s AS (SELECT n1, n2, coalesce(sum(count_fwd + count_rev) OVER (ORDER BY n1, n2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, sum(count_fwd + count_rev) OVER () AS total FROM p)
  SELECT n1, n2, least(floor(seen * 16 / total)::INT, 15) AS bin FROM s""")
def edge_bins(spark, sf_dir):
    return graph.binned(edge_counts(spark, sf_dir), 16).select("n1", "n2", "bin")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_regionkey + 1000 AS b FROM nation), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT DISTINCT a AS node, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node WHERE r.label < u.b)
  SELECT node, min(label) AS component FROM r GROUP BY node""")
def graph_components(spark, sf_dir):
    """Components of nations and their regions: several hubs with their leaves."""
    n = table(spark, sf_dir, "nation")
    return graph.connected_components(n.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b")))


# no SQL: a recursive query keeps a row for each node and label that reaches it; tests/test_components.py compares with a union-find
@query()
def graph_components_all(spark, sf_dir):
    """Components over all links of parts and suppliers."""
    l = table(spark, sf_dir, "lineitem")
    return graph.connected_components(l.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100_000_000).alias("b")))


@query("SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS members FROM lineitem GROUP BY 1")
def fragment_regroup(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("read_no"), F.lit(0).alias("sample"), F.col("l_orderkey").cast("string").alias("qname"))
    out = candidates.regrouped(found, keys=("l_orderkey",))
    return out.select("l_orderkey", F.size("observations").cast("long").alias("n"), F.array_join(F.transform("observations", lambda o: o["read_no"].cast("string")), ",").alias("members"))


def records(spark, sf_dir):
    """Orders as variant records of two samples."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "DEL").when(key % 4 == 1, "INS").when(key % 4 == 2, "DUP").otherwise("BND")
    size = key % 2000 + 1
    alt = F.when(kind == "BND", F.concat(F.lit("A["), F.concat(F.lit("c"), (key % 7).cast("string")), F.lit(":"), (F.col("o_custkey") + size).cast("string"), F.lit("["))).when(size <= 10, F.concat(F.lit("A"), F.repeat(F.lit("C"), size.cast("int")))).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    text = F.when(kind == "BND", F.concat(F.lit("SVTYPE=BND;MATEID=v"), F.when(key % 8 == 3, key + 4).otherwise(key - 4).cast("string"))).otherwise(F.concat(F.lit("END="), (F.col("o_custkey") + size).cast("string"), F.lit(";SVTYPE="), kind, F.lit(";SVLEN="), F.when(kind == "DEL", -size).otherwise(size).cast("string")))
    gt = lambda k: F.when((key + k) % 3 == 0, "0/0").when((key + k) % 3 == 1, "0/1").otherwise("1/1")
    sample = lambda k: F.concat_ws(":", gt(k), F.when((key + k) % 5 == 0, "PASS").otherwise("MinGQ"), F.concat_ws(",", (key % 9).cast("string"), ((key + k) % 4).cast("string")))
    return o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), F.col("o_custkey").cast("int").alias("pos"), F.concat(F.lit("v"), key.cast("string")).alias("id"), F.lit("A").alias("ref"), alt.alias("alt"),
        F.floor("o_totalprice").alias("qual"), F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("low"), F.col("o_orderstatus")))).alias("filter"), text.alias("info"),
        F.lit("GT:FT:PR").alias("format"), F.array(sample(0), sample(1), sample(2)).alias("samples"),
    ).withColumn("qual", F.col("qual").cast("double"))


RECORDS = """v AS (SELECT o_orderkey AS k, 'c' || (o_custkey % 5) AS chrom, o_custkey::INT AS pos, 'v' || o_orderkey AS id, 'A' AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP' ELSE 'BND' END AS kind,
  o_orderkey % 2000 + 1 AS size, floor(o_totalprice) AS qual, o_orderstatus = 'F' AS pass, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'low' || o_orderstatus END AS labels FROM orders),
  w AS (SELECT *, CASE WHEN kind = 'BND' THEN 'A[c' || (k % 7) || ':' || (pos + size) || '[' WHEN size <= 10 THEN 'A' || repeat('C', size::INT) ELSE '<' || kind || '>' END AS alt,
  CASE WHEN kind = 'BND' THEN pos ELSE pos + size END AS stop, CASE WHEN kind = 'BND' THEN 'v' || (CASE WHEN k % 8 = 3 THEN k + 4 ELSE k - 4 END) END AS mate FROM v)"""


@query(f"""WITH {RECORDS}, c AS (SELECT n_nationkey AS tid, 'c' || n_nationkey AS label FROM nation WHERE n_nationkey < 3)
  SELECT id, row_number() OVER (ORDER BY coalesce(tid, 3), chrom, pos, stop, ref, alt, id) AS place FROM w LEFT JOIN c ON label = chrom""")
def vcf_order(spark, sf_dir):
    c = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("tid"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("label"))
    r = vcf.contig_rank(records(spark, sf_dir), c).withColumn("end_pos", vcf.end_pos())
    # numbers of range partitions are offset by their counts, so no task sees all rows
    parts = r.repartitionByRange("rank", "chrom", "pos").sortWithinPartitions(*vcf.ORDER).withColumn("_p", F.spark_partition_id())
    parts = graph.checkpointed(parts.select(*vcf.ORDER, "_p"), "order")
    from pyspark.sql.window import Window

    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "_p").select("id", (F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*vcf.ORDER))).alias("place"))


@query(f"""WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt, stop ORDER BY NOT pass, qual DESC, alt LIKE '<%', id) AS n FROM w),
  g AS (SELECT mate FROM r WHERE n > 1 AND mate IS NOT NULL) SELECT id FROM r WHERE n = 1 AND id NOT IN (SELECT mate FROM g)""")
def best_record_dedupe(spark, sf_dir):
    return vcf.best_of_equal(records(spark, sf_dir)).select("id")


@query(f"WITH {RECORDS} SELECT a.id, b.chrom AS m_chrom, b.pos AS m_pos FROM w a LEFT JOIN w b ON a.mate = b.id WHERE a.kind = 'BND'")
def mate_self_join(spark, sf_dir):
    return vcf.mates(records(spark, sf_dir)).select("id", "m_chrom", "m_pos")


@query(f"WITH {RECORDS} SELECT id FROM w WHERE alt NOT SIMILAR TO '.*[<>\\[\\]:].*' AND length(alt) <= 9 AND length(ref) <= 9")
def small_indel_filter(spark, sf_dir):
    return vcf.small_indels(records(spark, sf_dir)).select("id")


@query(f"WITH {RECORDS} SELECT id FROM w WHERE kind = 'BND' OR size >= 50")
def min_size_filter(spark, sf_dir):
    return vcf.large_enough(records(spark, sf_dir), 50).select("id")


@query(f"WITH {RECORDS} SELECT id FROM w WHERE (kind = 'BND' AND 'c' || (k % 7) <> chrom) OR size <= 1000")
def intrachrom_filter(spark, sf_dir):
    return vcf.within_contig(records(spark, sf_dir), 1000).select("id")


@query(f"WITH {RECORDS} SELECT id, CASE WHEN k % 5 = 0 OR (k + 1) % 5 = 0 OR (k + 2) % 5 = 0 THEN labels WHEN labels = '' THEN 'SampleFT' ELSE 'SampleFT;' || labels END AS labels FROM w")
def filter_labels(spark, sf_dir):
    return vcf.sample_filter_refreshed(records(spark, sf_dir)).select("id", F.array_join("filter", ";").alias("labels"))


@query(f"WITH {RECORDS} SELECT id FROM w WHERE k % 4 > 0 OR (k + 1) % 4 > 0 OR (k + 2) % 4 > 0")
def pair_support_filter(spark, sf_dir):
    return vcf.with_pair_support(records(spark, sf_dir)).select("id")


_GT = "CASE (k + {n}) % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END"


@query(f"""WITH {RECORDS}, g AS (SELECT id, {_GT.format(n=0)} AS p, {_GT.format(n=1)} AS m, {_GT.format(n=2)} AS f FROM w)
  SELECT id, CASE WHEN (contains(m, p[1]) AND contains(f, p[3])) OR (contains(m, p[3]) AND contains(f, p[1])) THEN 0 ELSE 60 END AS dq FROM g""")
def trio_consistency(spark, sf_dir):
    return vcf.de_novo(records(spark, sf_dir), 0, 1, 2).select("id", "dq")


@query(f"WITH {RECORDS} SELECT {_GT.format(n=0)} || '-' || {_GT.format(n=1)} || '-' || {_GT.format(n=2)} AS genotypes, count(*) AS n FROM w GROUP BY 1")
def trio_genotypes(spark, sf_dir):
    return vcf.genotype_table(records(spark, sf_dir), (0, 1, 2))


@query(f"""WITH {RECORDS} SELECT chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || qual::BIGINT || chr(9) || CASE WHEN pass THEN 'PASS' ELSE labels END || chr(9) ||
  CASE WHEN kind = 'BND' THEN 'SVTYPE=BND;MATEID=' || mate ELSE 'END=' || stop || ';SVTYPE=' || kind || ';SVLEN=' || CASE WHEN kind = 'DEL' THEN -size ELSE size END END AS line FROM w""")
def vcf_lines(spark, sf_dir):
    return vcf.lines(records(spark, sf_dir).drop("format", "samples"))


@query(f"""WITH {RECORDS}, a AS (SELECT chrom, pos, ref, alt FROM w WHERE qual > 100000), b AS (SELECT chrom, pos, ref, alt FROM w WHERE qual > 150000 OR kind = 'DEL')
  SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set_compare(spark, sf_dir):
    r = records(spark, sf_dir)
    return vcf.differences(r.where("qual > 100000"), r.where((F.col("qual") > 150000) | (vcf.info("SVTYPE") == "DEL")), ("chrom", "pos", "ref", "alt"))


@query(f"""WITH {RECORDS}, t AS (SELECT * FROM w WHERE pass AND kind IN ('DEL', 'DUP')) SELECT a.id AS a_id, b.id AS b_id FROM t a JOIN t b
  ON a.chrom = b.chrom AND a.pos < b.stop AND b.pos < a.stop AND a.id < b.id AND b.size < 2 * a.size AND b.size > 0.5 * a.size""")
def stacked_variants(spark, sf_dir):
    r = records(spark, sf_dir).where(vcf.is_pass() & vcf.info("SVTYPE").isin("DEL", "DUP")).select("chrom", "id", "pos", vcf.end_pos().alias("stop"), F.abs(vcf.info("SVLEN").cast("int")).alias("len"))
    return vcf.stacked_pairs(r, "chrom", "pos", "stop", F.col("len")).where("id < o_id").select(F.col("id").alias("a_id"), F.col("o_id").alias("b_id"))


@query("SELECT regexp_extract(event_type || '_' || event_id, '^([^0-9]*?)[_-]?(?:[0-9].*)?$', 1) AS kind, round(sum(value), 4) AS seconds, count(*) AS n FROM events GROUP BY 1")
def timing_breakdown(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", "event_id").alias("task"), F.col("value").cast("decimal(18,2)").alias("seconds"))
    return vcf.timing(log).withColumn("seconds", F.round(F.col("seconds").cast("double"), 4))


@query("""WITH d AS (SELECT doc_id, translate(text, 'BDEFHIJKLMNOPQRSUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') AS s FROM documents), k AS (SELECT DISTINCT doc_id, s[i:i + 5] AS word FROM (SELECT doc_id, s, unnest(range(1, length(s) - 4)) AS i FROM d))
  SELECT word, count(*) AS n FROM k WHERE NOT regexp_matches(word, '[^ACGT]') AND length(word) = 6 GROUP BY word""")
def kmer_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.translate("text", "BDEFHIJKLMNOPQRSUVWXYZabcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC").alias("s"))
    return seq.word_counts(d, [], F.col("s"), 6).where(~F.col("word").rlike("[^ACGT]"))


@query("SELECT p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc, regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g') AS std FROM part")
def reverse_complements(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", seq.reverse_complement(F.upper("p_name")).alias("rc"), seq.standard(F.col("p_name")).alias("std"))


def fragments(spark, sf_dir):
    """Line items as fragments of the part's event: pair probabilities by discount and tax, no split reads."""
    none, yes, no = F.lit(0.0), F.lit(True), F.lit(False)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("event"), F.lit(0).alias("junction"), F.col("l_returnflag").alias("sample"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"),
        *[yes.alias(f"r{k}_{x}") for k in (1, 2) for x in ("scanned", "anchored", "anchored2")], (F.col("l_discount") / 2 + 0.001).alias("ref_pair"), (F.col("l_tax") / 2 + 0.001).alias("alt_pair"),
        *[no.alias(f"r{k}_{x}") for k in (1, 2) for x in ("split", "split2")], *[none.alias(f"r{k}_{x}_lnl") for k in (1, 2) for x in ("ref", "alt")], F.lit(1.0).alias("pair_weight"),
    )


FRAGMENTS = """f AS (SELECT l_partkey AS event, l_returnflag AS sample, ln(0.999 * (l_discount / 2 + 0.001) + 0.001) AS r, ln(0.999 * (l_tax / 2 + 0.001) + 0.001) AS a, l_discount / 2 + 0.001 AS rp, l_tax / 2 + 0.001 AS ap FROM lineitem),
  l AS (SELECT event, sample, sum(r) AS l0, sum(greatest(r, a) + ln(0.5 * exp(r - greatest(r, a)) + 0.5 * exp(a - greatest(r, a)))) AS l1, sum(greatest(r, a) + ln((1 - 0.99) * exp(r - greatest(r, a)) + 0.99 * exp(a - greatest(r, a)))) AS l2 FROM f GROUP BY 1, 2),
  q AS (SELECT *, l0 + ln(1 - 1.5e-5) AS p0, l1 + ln(1e-5) AS p1, l2 + ln(5e-6) AS p2 FROM l), t AS (SELECT *, greatest(p0, p1, p2) AS top FROM q),
  u AS (SELECT *, exp(p0 - top) AS w0, exp(p1 - top) AS w1, exp(p2 - top) AS w2 FROM t), z AS (SELECT *, w0 + w1 + w2 AS total FROM u)"""


@query(f"WITH {FRAGMENTS} SELECT event, sample, CASE WHEN p0 = top THEN 'REF' WHEN p1 = top THEN 'HET' ELSE 'HOM' END AS gt, round(w0 / total, 6) AS p_ref FROM z")
def genotype_posterior(spark, sf_dir):
    return scoring.diploid(fragments(spark, sf_dir)).select("event", "sample", "gt", F.round("p_ref", 6).alias("p_ref"))


@query(f"""WITH {FRAGMENTS} SELECT event, sample, 0::BIGINT AS ref_split, count(*) AS ref_spanning, count(*) FILTER (rp >= ap AND rp / (rp + ap) > 0.9) AS ref_confident_spanning, 0::BIGINT AS alt_split, count(*) FILTER (ap >= rp AND ap / (rp + ap) > 0.9) AS alt_confident_spanning FROM f GROUP BY 1, 2""")
def support_counts(spark, sf_dir):
    c = scoring.support_counts(fragments(spark, sf_dir), ("event", "sample"))
    return c.select("event", "sample", "ref_split", "ref_spanning", "ref_confident_spanning", "alt_split", "alt_confident_spanning")


@query()
def somatic_scores(spark, sf_dir):
    """Somatic scores of each part's event, N as the normal and R as the tumour sample."""
    f = fragments(spark, sf_dir).withColumns({"size": F.lit(20_000), "same_contig": F.lit(True), "junctions": F.lit(1)})
    counts = scoring.support_counts(f).withColumn("pair_weight", F.lit(1.0))
    return scoring.somatic(f, counts, "N", "R")


@query()
def breakend_graph(spark, sf_dir):
    """The flagship: events as paired breakends, merged into the thresholded graph; bidirectional edges with their intervals."""
    s = spans(spark, sf_dir)
    node = lambda b: F.struct(F.col("tid").cast("int").alias("tid"), b.cast("int").alias("begin"), (b + 3600).cast("int").alias("end"))
    w = F.when(F.col("event_type") == "error", 1).otherwise(3).cast("long")
    rows = s.select(F.explode(F.array(F.struct(node(F.col("begin")).alias("a"), node(F.col("end") + 20_000).alias("b"), w.alias("w")), F.struct(node(F.col("end") + 20_000).alias("a"), node(F.col("begin")).alias("b"), w.alias("w")))).alias("e")).select("e.a", "e.b", "e.w")
    nodes, edges = graph.merge(rows)
    pairs = graph.cleaned(graph.paired(edges))
    named = lambda k: nodes.select(F.col("node").alias(f"n{k}"), F.col("tid").alias(f"tid{k}"), F.col("begin").alias(f"begin{k}"), F.col("end").alias(f"end{k}"))
    return pairs.where(graph.bidirectional()).join(named(1), "n1").join(named(2), "n2").select("locus", "tid1", "begin1", "end1", "tid2", "begin2", "end2", "count_fwd", "count_rev")
