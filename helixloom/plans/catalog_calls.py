"""More driver queries, on the same star-schema tables: observations, candidates, support, models and records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar, prob, seq
from ..operators import candidates, graph, intervals, observations, partitioning, reads, scoring, stats, support, vcf
from .catalog import ALIGNMENTS, CLEAN, ENDS, LINKS, RECORDS, SPANS, _NODES, _nodes, alignments, edge_counts, links, query, records, spans, table


# reads


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'no sequence' WHEN l_suppkey % 7 = 1 THEN 'illegal base ''=''' WHEN l_partkey % 3 > 0 AND l_suppkey % 5 > 0 THEN 'alignment and sequence differ in length' END AS reason FROM lineitem""")
def invalid_records(spark, sf_dir):
    """why records are malformed."""
    l = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_suppkey") % 7 == 0, "*").when(F.col("l_suppkey") % 7 == 1, "AC=T").otherwise("ACGT")
    path = F.when(F.col("l_suppkey") % 5 > 0, "9M").otherwise("4M")
    df = l.withColumns({"seq": text, "is_unmapped": F.col("l_partkey") % 3 == 0, "path": cigar.parse(path)})
    return df.select("l_orderkey", "l_linenumber", reads.invalid_reason().alias("reason"))


@query(f"""WITH {ALIGNMENTS}, m AS (SELECT *, pos0 + match + del + 20 AS ref_end, mate_pos0 + l_linenumber + match + 20 AS mate_end FROM i), o AS (SELECT *, innie AND (CASE WHEN fwd THEN ref_end >= mate_pos0 + 1 ELSE mate_end >= pos0 + 1 END) AS over FROM m)
  SELECT qname, over, over AND (CASE WHEN fwd THEN 0 ELSE l_linenumber END) > 0 AS adapter, pair AND mapq >= 15 AND (tid <> mate_tid OR abs(pos0 - mate_pos0) >= 300) AS far FROM o""")
def pair_tests(spark, sf_dir):
    """Overlapping and adapter pairs by the mate's path, and mates that lie elsewhere."""
    r = reads.with_flags(alignments(spark, sf_dir))
    return r.select("qname", reads.overlapping_pair().alias("over"), reads.adapter_pair().alias("adapter"), reads.mate_insertion(reads.Options(remote_distance=300)).alias("far"))


def windows_of_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") % 8).cast("int").alias("tid"), (F.col("p_partkey") * 10).alias("begin"), (F.col("p_partkey") * 10 + F.col("p_size") * 3).alias("end"), F.col("p_size").cast("double").alias("depth"))


@query(f"WITH {ALIGNMENTS} SELECT qname, EXISTS (SELECT 1 FROM part WHERE p_partkey % 8 = tid AND p_partkey * 10 <= pos0 AND pos0 < p_partkey * 10 + p_size * 3 AND p_size > 12 * (1.5 + tid / 4)) AS is_deep FROM a")
def depth_filter(spark, sf_dir):
    """reads that start where the depth is above a multiple of their contig's."""
    limits = spark.range(8).select(F.col("id").cast("int").alias("tid"), (1.5 + F.col("id") / 4).alias("depth"))
    return reads.depth_filtered(alignments(spark, sf_dir), windows_of_parts(spark, sf_dir), limits).select("qname", "is_deep")


def mated(spark, sf_dir):
    """Line items as two reads of a fragment: the first mapped, the second by line number unmapped, with simple paths."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6")
    name = F.concat_ws("/", "l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).cast("string"))
    second = F.col("l_linenumber") % 2 == 0
    flag = F.when(second, F.when(F.col("l_orderkey") % 3 == 0, 1 + 4 + 128).otherwise(1 + 16 + 128)).otherwise(F.when(F.col("l_orderkey") % 3 == 0, 1 + 8 + 64).otherwise(1 + 32 + 64))
    return l.select(
        name.alias("qname"), flag.cast("int").alias("flag"), F.lit("s").alias("sample"), (F.col("l_orderkey") % 4).cast("int").alias("tid"), (F.col("l_suppkey") % 40 + F.when(second, 100).otherwise(0)).cast("int").alias("pos0"), (F.col("l_quantity") % 40).cast("int").alias("mapq"),
        F.when(F.col("l_tax") > 0.06, "5S45M").when(F.col("l_tax") > 0.03, "45M5S").otherwise("50M").alias("cigar"), (F.col("l_orderkey") % 4).cast("int").alias("mate_tid"), F.lit(200).alias("mate_pos0"), F.when(second, -150).otherwise(150).alias("tlen"), F.repeat(F.lit("A"), 50).alias("seq"),
        F.array((F.col("l_discount") * 400).cast("int"), F.lit(30)).alias("qual"), F.lit(None).cast("string").alias("sa"), F.lit(None).cast("string").alias("mc"),
    )


MATED = """b AS (SELECT l_orderkey || '/' || ((l_linenumber - 1) // 2) AS qname, l_linenumber % 2 = 0 AS second, l_orderkey % 3 = 0 AS shadowed, l_orderkey % 4 AS tid, l_suppkey % 40 + CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 0 END AS pos0,
  (l_quantity % 40)::INT AS mapq, CASE WHEN l_tax > 0.06 THEN 'lead' WHEN l_tax > 0.03 THEN 'trail' ELSE 'none' END AS clip, ((l_discount * 400)::DECIMAL(9, 4)::DOUBLE)::INT AS q, l_discount FROM lineitem WHERE l_linenumber <= 6)"""


@query(f"WITH {MATED} SELECT s.qname, a.pos0::INT AS anchor_pos0 FROM b s JOIN b a ON s.qname = a.qname WHERE s.second AND s.shadowed AND NOT a.second AND a.shadowed AND a.mapq >= 15 AND (floor(round(s.l_discount * 400, 4)) + 30) / 2.0 >= 25")
def shadow_reads(spark, sf_dir):
    """unmapped reads with their mapped mates."""
    return reads.shadows(reads.with_flags(mated(spark, sf_dir))).select("qname", "anchor_pos0")


@query(f"""WITH {MATED}, u AS (SELECT *, CASE WHEN second THEN 145 + 16 ELSE 97 END AS flag FROM b WHERE NOT shadowed AND mapq <> 0 AND clip <> (CASE WHEN second THEN 'trail' ELSE 'lead' END)),
  n AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY tid, pos0, second ORDER BY qname, flag) = 1) SELECT qname FROM (SELECT *, count(*) OVER (PARTITION BY qname) AS mates FROM n) WHERE mates > 1 AND NOT second""")
def insert_size_filter(spark, sf_dir):
    """reads that the fragment-size estimate uses."""
    return reads.insert_size_reads(reads.with_flags(mated(spark, sf_dir))).select("qname")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = (s_suppkey // 2) % 2 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Fp' ELSE 'Fm' END WHEN (s_nationkey <= 12) = (s_suppkey % 2 = 0) THEN 'Rp' ELSE 'Rm' END AS orientation FROM supplier")
def pair_orientations(spark, sf_dir):
    """The orientation of a pair."""
    s = table(spark, sf_dir, "supplier").withColumns({"pos0": F.col("s_nationkey"), "mate_pos0": F.lit(12), "is_fwd": F.col("s_suppkey") % 2 == 0, "is_mate_fwd": F.floor(F.col("s_suppkey") / 2) % 2 == 0})
    return s.select("s_suppkey", reads.pair_orientation().alias("orientation"))


# observations


def contigs_of(spark):
    return spark.range(8).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"), F.lit(100_000_000).alias("length"))


_WINDOW = "greatest(0, {p} - 20)::INT AS {n}_begin, least(100000000, {p} + 20)::INT AS {n}_end"


@query(f"""WITH {ALIGNMENTS} SELECT qname, {_WINDOW.format(p="(pos0 + match)", n="bp1")}, {_WINDOW.format(p="(pos0 + match + del)", n="bp2")}, 1 AS bp1_state, 2 AS bp2_state FROM a WHERE del >= 8""")
def indel_observations(spark, sf_dir):
    """Large deletions as breakend windows."""
    return observations.from_indels(reads.with_flags(alignments(spark, sf_dir)), contigs_of(spark)).select("qname", "bp1_begin", "bp1_end", "bp2_begin", "bp2_end", "bp1_state", "bp2_state")


def split_alignments(spark, sf_dir):
    tag = F.concat(F.lit("c"), (F.col("l_partkey") % 8).cast("string"), F.lit(","), (F.col("l_suppkey") * 1000 + 1).cast("string"), F.lit(","), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.lit(",30M"), F.col("l_linenumber").cast("string"), F.lit("S,"), (F.col("l_linenumber") * 9).cast("string"), F.lit(",0;"))
    more = F.when(F.col("l_linenumber") == 7, F.concat(tag, tag)).otherwise(tag)
    l = table(spark, sf_dir, "lineitem").withColumns({"qname": F.concat_ws("/", "l_orderkey", "l_linenumber"), "sa": more})
    return l.select("qname", "sa", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT l_orderkey || '/' || l_linenumber AS qname, CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS n, 'c' || (l_partkey % 8) AS chrom, (l_suppkey * 1000)::INT AS pos0, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, '30M' || l_linenumber || 'S' AS cigar, (l_linenumber * 9)::INT AS mapq FROM lineitem")
def split_tags(spark, sf_dir):
    """O2: split tags in parts."""
    s = split_alignments(spark, sf_dir).withColumn("p", observations.split_segments(F.col("sa")))
    return s.select("qname", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("f")).select("qname", "n", "f.*")


@query(f"""SELECT l_orderkey || '/' || l_linenumber AS qname, CASE WHEN l_suppkey % 12 < 6 THEN 1 ELSE 2 END AS bp1_state, {_WINDOW.format(p="(l_partkey * 10 + CASE WHEN l_suppkey % 12 < 6 THEN 40 ELSE 0 END)", n="bp1")},
  1 AS bp2_state, (l_partkey % 8)::INT AS bp2_tid, {_WINDOW.format(p="(l_suppkey * 1000 + 30)", n="bp2")}, 3 AS w_local, 0 AS w_remote FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6""")
def split_observations(spark, sf_dir):
    """O3: split reads with one good segment."""
    s = split_alignments(spark, sf_dir)
    path = F.concat((F.col("l_suppkey") % 12 + 1).cast("string"), F.lit("S40M7S"))
    r = s.withColumns({"flag": F.lit(0), "sample": F.lit(0), "tid": (F.col("l_suppkey") % 8).cast("int"), "pos0": (F.col("l_partkey") * 10).cast("int"), "cigar": path})
    found = observations.from_splits(reads.with_flags(r), contigs_of(spark))
    return found.select("qname", "bp1_state", "bp1_begin", "bp1_end", "bp2_state", "bp2_tid", "bp2_begin", "bp2_end", "w_local", "w_remote")


@query("""WITH q AS (SELECT l_orderkey || '/' || l_linenumber AS qname, l_suppkey % 2 = 0 AS fwd, l_partkey % 2 = 0 AS mfwd, l_partkey * 10 + 1000 AS pos, l_suppkey * 100 + 1000 AS mpos, l_suppkey % 8 AS tid, l_partkey % 8 AS mtid FROM lineitem),
  c AS (SELECT *, tid = mtid AND fwd <> mfwd AND (CASE WHEN fwd THEN pos ELSE mpos END) <= (CASE WHEN fwd THEN mpos ELSE pos END) AS innie, 100 + (CASE WHEN fwd THEN mpos - (pos + 50) ELSE pos - (mpos + 50) END) AS size, abs(mpos - pos) + 50 AS tlen FROM q),
  k AS (SELECT *, CASE WHEN tid <> mtid OR fwd = mfwd OR size < 0 THEN 1.0 WHEN size > 408 THEN greatest(0.0, least(1.0, (size - 4000) / 4000.0)) ELSE -1.0 END AS scale FROM c WHERE NOT innie OR tlen > 600 OR tlen < 150),
  j AS (SELECT *, greatest(40, floor(scale * 400 + (1 - scale) * 300 - 100)::INT) AS reach FROM k WHERE scale >= 0 AND (NOT innie OR tlen > 400))
  SELECT qname, CASE WHEN fwd THEN 1 ELSE 2 END AS bp1_state, (CASE WHEN fwd THEN pos + 50 ELSE greatest(0, pos - reach) END)::INT AS bp1_begin, (CASE WHEN fwd THEN pos + 50 + reach ELSE pos END)::INT AS bp1_end,
    CASE WHEN mfwd THEN 1 ELSE 2 END AS bp2_state, (CASE WHEN mfwd THEN mpos + 50 ELSE greatest(0, mpos - reach) END)::INT AS bp2_begin, (CASE WHEN mfwd THEN mpos + 50 + reach ELSE mpos END)::INT AS bp2_end,
    CASE WHEN innie AND tlen < 1600 THEN 1 ELSE 3 END AS w_local FROM j""")
def pair_observations(spark, sf_dir):
    """Anomalous pairs as breakends as wide as fragment sizes allow."""
    l = table(spark, sf_dir, "lineitem")
    pos, mpos = F.col("l_partkey") * 10 + 1000, F.col("l_suppkey") * 100 + 1000
    flag = F.lit(1) + F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(16) + F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(32)
    r = l.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), flag.alias("flag"), F.lit(0).alias("sample"), (F.col("l_suppkey") % 8).cast("int").alias("tid"), pos.cast("int").alias("pos0"), F.lit("50M").alias("cigar"), F.repeat(F.lit("A"), 50).alias("seq"), F.lit(None).cast("string").alias("sa"), F.lit(None).cast("string").alias("mc"),
        (F.col("l_partkey") % 8).cast("int").alias("mate_tid"), mpos.cast("int").alias("mate_pos0"), (F.abs(mpos - pos) + 50).cast("int").alias("tlen"), F.lit(150).alias("pp_min"), F.lit(400).alias("pp_max"), F.lit(300).alias("be_max"), F.lit(4000).alias("large_low"), F.lit(8000).alias("large_high"),
    )
    return observations.from_pairs(reads.with_flags(r), contigs_of(spark)).select("qname", "bp1_state", "bp1_begin", "bp1_end", "bp2_state", "bp2_begin", "bp2_end", "w_local")


def found_pairs(spark, sf_dir):
    """Line items as observations of both reads of a fragment (an order's lines two by two)."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6")
    first = F.col("l_linenumber") % 2 == 1
    at, to = F.col("l_orderkey") % 50 * 10, F.col("l_orderkey") % 50 * 10 + 300 + F.col("l_orderkey") % 3 * 100
    own, other = F.when(first, at).otherwise(to), F.when(first, to).otherwise(at)
    shift = F.col("l_partkey") % 60
    return l.select(
        F.lit(0).alias("sample"), F.concat_ws("/", "l_orderkey", F.floor((F.col("l_linenumber") - 1) / 2).cast("string")).alias("qname"), F.when(first, 1).otherwise(2).alias("read_no"), F.when(F.col("l_tax") > 0.07, "CIGAR").otherwise("LOCAL_PAIR").alias("ev_type"),
        F.when(first, 1).otherwise(2).alias("bp1_state"), F.lit(0).alias("bp1_tid"), (own + shift).cast("int").alias("bp1_begin"), (own + shift + 50).cast("int").alias("bp1_end"),
        F.when(first, 2).otherwise(1).alias("bp2_state"), F.lit(0).alias("bp2_tid"), other.cast("int").alias("bp2_begin"), (other + 50).cast("int").alias("bp2_end"), F.lit(3).alias("w_local"), F.lit(0).alias("w_remote"),
        *[F.lit(0).alias(x) for x in ("r1_tid", "r1_pos", "r2_tid", "r2_pos")],
    )


FOUND = """o AS (SELECT l_orderkey || '/' || ((l_linenumber - 1) // 2) AS qname, l_linenumber % 2 = 1 AS first, l_tax > 0.07 AS indel, l_orderkey % 50 * 10 AS frm, l_orderkey % 50 * 10 + 300 + l_orderkey % 3 * 100 AS onto, l_partkey % 60 AS shift FROM lineitem WHERE l_linenumber <= 6),
  e AS (SELECT qname, CASE WHEN first THEN 1 ELSE 2 END AS read_no, CASE WHEN indel THEN 'CIGAR' ELSE 'LOCAL_PAIR' END AS ev_type, CASE WHEN first THEN 1 ELSE 2 END AS s1, CASE WHEN first THEN frm ELSE onto END + shift AS b1, CASE WHEN first THEN frm ELSE onto END + shift + 50 AS e1,
    CASE WHEN first THEN 2 ELSE 1 END AS s2, CASE WHEN first THEN onto ELSE frm END AS b2, CASE WHEN first THEN onto ELSE frm END + 50 AS e2 FROM o),
  both_ AS (SELECT a.* FROM e a JOIN e b ON a.qname = b.qname WHERE a.ev_type = 'LOCAL_PAIR' AND b.ev_type = 'LOCAL_PAIR' AND a.read_no = 1 AND b.read_no = 2 AND a.b1 < b.e2 AND b.b2 < a.e1 AND a.b2 < b.e1 AND b.b1 < a.e2),
  g AS (SELECT qname, read_no, 'PAIR' AS ev_type, s1, b1, e1, s2, b2, e2, 3 AS w_remote FROM both_ UNION ALL SELECT qname, read_no, ev_type, s1, b1, e1, s2, b2, e2, 0 FROM e WHERE ev_type = 'CIGAR' OR qname NOT IN (SELECT qname FROM both_))"""


@query(f"WITH {FOUND} SELECT qname, read_no, ev_type, b1::INT AS bp1_begin, e1::INT AS bp1_end, b2::INT AS bp2_begin, e2::INT AS bp2_end, w_remote FROM g")
def fragment_observations(spark, sf_dir):
    """Both reads' observations of a fragment as one where they agree."""
    return observations.fragments(found_pairs(spark, sf_dir)).select("qname", "read_no", "ev_type", "bp1_begin", "bp1_end", "bp2_begin", "bp2_end", "w_remote")


@query(f"""WITH {FOUND}, n AS (SELECT *, s1 = 1 AND s2 = 2 AND b1 - 130 < e2 + 130 AND b2 - 130 < e1 + 130 AS near FROM g)
  SELECT qname, read_no, CASE WHEN near THEN 3 ELSE s1 END AS bp1_state, CASE WHEN near THEN 0 ELSE s2 END AS bp2_state, (CASE WHEN near THEN least(b1, b2) ELSE b1 END)::INT AS bp1_begin, (CASE WHEN near THEN greatest(e1, e2) ELSE e1 END)::INT AS bp1_end FROM n""")
def near_indels(spark, sf_dir):
    """Indel-like observations whose padded breakends meet."""
    return observations.collapsed_near_indels(observations.fragments(found_pairs(spark, sf_dir)), 130).select("qname", "read_no", "bp1_state", "bp2_state", "bp1_begin", "bp1_end")


@query(f"""WITH {FOUND}, m AS (SELECT *, b1 < e2 AND b2 < e1 AS meet FROM g), r AS (
  SELECT least(b1, b2) AS ab, greatest(e1, e2) AS ae, least(b1, b2) AS bb, greatest(e1, e2) AS be, greatest(3, w_remote) AS w FROM m WHERE meet UNION ALL SELECT b1, e1, b2, e2, 3 FROM m WHERE NOT meet UNION ALL SELECT b2, e2, b1, e1, w_remote FROM m WHERE NOT meet)
  SELECT ab::INT AS a_begin, ae::INT AS a_end, bb::INT AS b_begin, be::INT AS b_end, sum(w)::BIGINT AS w, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def directed_evidence(spark, sf_dir):
    """Observations as directed edges, both ways, added up."""
    p = observations.proto_edges(observations.fragments(found_pairs(spark, sf_dir)))
    return p.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n")).select(F.col("a.begin").alias("a_begin"), F.col("a.end").alias("a_end"), F.col("b.begin").alias("b_begin"), F.col("b.end").alias("b_end"), "w", "n")


# candidates


def calls(spark, sf_dir):
    """Orders as candidates: states, places and counts by arithmetic on the keys; an edge has the orders of a customer."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    state = F.when(k % 5 == 0, 3).otherwise(k % 2 + 1)
    b1, b2 = k % 5000, k % 3000 + F.when(k % 9 == 0, 100_000).otherwise(200)
    return o.select(
        k.alias("key"), F.lit(1).cast("long").alias("locus"), F.col("o_custkey").alias("n1"), (F.col("o_custkey") + 1).alias("n2"), k.cast("int").alias("cand"), state.cast("int").alias("bp1_state"), F.when(k % 5 == 0, 0).otherwise(F.floor(k / 2) % 2 + 1).cast("int").alias("bp2_state"),
        (k % 3).cast("int").alias("bp1_tid"), (k % 3 + F.when(k % 7 == 0, 1).otherwise(0)).cast("int").alias("bp2_tid"), b1.alias("bp1_begin"), (b1 + 40).alias("bp1_end"), b2.alias("bp2_begin"), (b2 + 30).alias("bp2_end"),
        (k % 4).alias("n_fragments"), (k % 3).alias("n_pair"), (k % 2).alias("n_split"), F.lit(0).cast("long").alias("n_indel"), F.lit(0).cast("long").alias("n_semi"), (k % 100 / 1000.0).cast("double").alias("p_signal"), (k % 11 * 10).cast("int").alias("inserted"),
    )


CALLS = """x AS (SELECT o_orderkey AS k, o_custkey AS n1, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE o_orderkey % 2 + 1 END AS s1, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey // 2 % 2 + 1 END AS s2, o_orderkey % 3 AS t1, o_orderkey % 3 + (o_orderkey % 7 = 0)::INT AS t2,
    o_orderkey % 5000 AS b1, o_orderkey % 5000 + 40 AS e1, o_orderkey % 3000 + CASE WHEN o_orderkey % 9 = 0 THEN 100000 ELSE 200 END AS b2, o_orderkey % 3000 + CASE WHEN o_orderkey % 9 = 0 THEN 100000 ELSE 200 END + 30 AS e2, o_orderkey % 4 AS nf, o_orderkey % 3 AS np, o_orderkey % 2 AS ns, o_orderkey % 100 / 1000.0 AS p, o_orderkey % 11 * 10 AS ins FROM orders),
  y AS (SELECT *, s1 = 3 AS cx, b1 + (e1 - b1 - 1) // 2 AS c1, b2 + (e2 - b2 - 1) // 2 AS c2 FROM x),
  t AS (SELECT *, abs(c2 - c1) - 1 AS size, CASE WHEN cx THEN 'COMPLEX' WHEN t1 <> t2 THEN 'INTERTRANSLOC' WHEN s1 = s2 THEN 'INVERSION' WHEN (CASE WHEN b1 <= b2 THEN s1 ELSE s2 END) = 1 THEN 'INDEL' ELSE 'TANDUP' END AS kind FROM y),
  mk AS (SELECT *, CASE WHEN NOT cx AND ns + np = 0 THEN 'SEMI_MAPPED' WHEN cx AND nf < 2 THEN 'COMPLEX_LOW_COUNT' WHEN cx AND p > 0.005 THEN 'COMPLEX_LOW_SIGNAL' WHEN NOT cx AND p > 0.03 THEN 'SPANNING_LOW_SIGNAL' END AS mark FROM t)"""


@query(f"""WITH {CALLS} SELECT k AS key, kind, CASE WHEN kind = 'INDEL' THEN CASE WHEN ins > greatest(size, 0) THEN 'INSERT' ELSE 'DELETE' END ELSE kind END AS extended, t1 = t2 AND s1 <> s2 AS cis, t1 = t2 AND greatest(size, ins) < 50 AS small,
  'SV:' || kind || ':1:' || n1 || ':' || (n1 + 1) || ':' || k || ':0:0' AS id FROM t""")
def candidate_types(spark, sf_dir):
    """Types, sizes and ids of candidates."""
    c = calls(spark, sf_dir).withColumns({"kind": candidates.sv_type(), "asm": F.lit(0), "seg": F.lit(0)})
    return c.select("key", "kind", candidates.extended_type(F.col("inserted")).alias("extended"), candidates.is_cis().alias("cis"), candidates.below_size(50, F.col("inserted")).alias("small"), candidates.junction_id().alias("id"))


@query(f"WITH {CALLS} SELECT k AS key, mark FROM mk WHERE mark IS NULL OR mark = 'SPANNING_LOW_SIGNAL'")
def candidate_marks(spark, sf_dir):
    """single-junction filters."""
    return candidates.filtered(calls(spark, sf_dir)).select("key", "mark")


EVENTS_OF = f"""{CALLS}, us AS (SELECT * FROM t WHERE NOT cx AND NOT (kind = 'INDEL' AND size < 100000)),
  pr AS (SELECT a.n1, a.k AS a, b.k AS b FROM us a JOIN us b ON a.n1 = b.n1 AND a.k < b.k WHERE (a.t1 = b.t1 AND a.s1 <> b.s1 AND abs(a.c1 - b.c1) < 2500 AND a.t2 = b.t2 AND a.s2 <> b.s2 AND abs(a.c2 - b.c2) < 2500)
    OR (a.t1 = b.t2 AND a.s1 <> b.s2 AND abs(a.c1 - b.c2) < 2500 AND a.t2 = b.t1 AND a.s2 <> b.s1 AND abs(a.c2 - b.c1) < 2500)),
  en AS (SELECT n1, a AS k FROM pr UNION ALL SELECT n1, b FROM pr), cr AS (SELECT n1 FROM en GROUP BY n1, k HAVING count(*) > 1), ok AS (SELECT * FROM pr WHERE n1 NOT IN (SELECT n1 FROM cr)),
  ev AS (SELECT mk.*, coalesce(ok.a, mk.k) AS event FROM mk LEFT JOIN (SELECT a, a AS k FROM ok UNION ALL SELECT a, b FROM ok) ok ON mk.k = ok.k)"""


@query(f"WITH {EVENTS_OF} SELECT k AS key, event::INT AS event FROM ev")
def junction_events(spark, sf_dir):
    """Pairs of junctions that belong together."""
    return candidates.junction_pairs(calls(spark, sf_dir), near=2500).select("key", "event")


@query(f"WITH {EVENTS_OF}, g AS (SELECT n1, event FROM ev GROUP BY 1, 2 HAVING bool_or(cx) OR (bool_or(np + ns >= 2) AND bool_or(mark IS NULL))) SELECT k AS key FROM ev SEMI JOIN g ON ev.n1 = g.n1 AND ev.event = g.event")
def event_filters(spark, sf_dir):
    """events with enough spanning evidence."""
    marked = candidates.junction_pairs(calls(spark, sf_dir), near=2500).withColumn("mark", candidates.junction_filter())
    return candidates.event_filter(marked, 2).select("key")


@query(f"""WITH {EVENTS_OF}, q AS (SELECT *, k % 2 = 0 AS imprecise FROM ev), g AS (SELECT n1, event FROM q GROUP BY 1, 2 HAVING bool_and(NOT imprecise OR np + ns >= 2) AND bool_or(NOT imprecise OR np + ns >= 2) AND bool_and(NOT cx OR NOT imprecise) AND bool_and(NOT (t1 = t2 AND greatest(size, ins) < 8)))
  SELECT k AS key FROM q SEMI JOIN g ON q.n1 = g.n1 AND q.event = g.event""")
def refined_filters(spark, sf_dir):
    """events after assembly."""
    e = candidates.junction_pairs(calls(spark, sf_dir), near=2500).withColumns({"imprecise": F.col("key") % 2 == 0, "insert_seq": F.repeat(F.lit("A"), F.col("inserted"))})
    return candidates.refined_filter(e, 2).select("key")


@query("SELECT p_partkey, round(CASE WHEN p_size % 6 = 0 THEN 1.0 ELSE list_sum(list_transform(range(p_size % 6, p_size + 1), lambda i: exp(lgamma(p_size + 1) - lgamma(i + 1) - lgamma(p_size - i + 1) + i * ln(0.1) + (p_size - i) * ln(0.9)))) END, 9) AS tail FROM part WHERE p_size >= 6")
def binomial_tails(spark, sf_dir):
    """C4: upper tails of the binomial."""
    p = table(spark, sf_dir, "part").where("p_size >= 6")
    return p.select("p_partkey", F.round(prob.binomial_tail((F.col("p_size") % 6).cast("int"), F.col("p_size").cast("int"), F.lit(0.1)), 9).alias("tail"))


@query("""WITH a AS (SELECT l_suppkey AS c, list_sort(list(l_partkey // 20)) AS places FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), w AS (SELECT *, least(4, len(places) - 1) AS w FROM a WHERE len(places) > 1),
  g AS (SELECT *, list_min(list_transform(range(1, len(places) - w + 1), lambda i: places[i + w] - places[i]))::BIGINT AS n FROM w), h AS (SELECT *, least(w, n) AS k FROM g)
  SELECT c::INT AS cand, round(CASE WHEN k = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8)))) END, 9) AS p_signal FROM h""")
def signal_tests(spark, sf_dir):
    """The peak density of a breakend's evidence among the reads."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    e = l.select(*[F.lit(0).cast("long").alias(x) for x in ("locus", "n1", "n2")], F.col("l_suppkey").cast("int").alias("cand"), F.lit(False).alias("is_complex"), F.lit(0).alias("sample"), F.lit(1).alias("bp"), F.floor(F.col("l_partkey") / 20).cast("long").alias("index"))
    rates = spark.range(1).select(F.lit(0).alias("sample"), F.lit(0.2).alias("anomalous_rate"), F.lit(0.1).alias("assembly_rate"))
    return candidates.signals(e, rates).select("cand", F.round("p_signal", 9).alias("p_signal"))


# graph


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, l AS (SELECT DISTINCT n2 - 100000000 AS node, count_fwd >= 40 AND count_rev >= 15 AS both_, n1 FROM p), c AS (SELECT node, count(*) FILTER (both_) AS n_both, count(*) FILTER (NOT both_) AS n_other FROM l GROUP BY 1) SELECT node, n_both, n_other, NOT (n_both BETWEEN 1 AND 2 AND n_other <= 4) AS is_skipped FROM c")
def isolated_edges(spark, sf_dir):
    """nodes with a self edge and how their other edges speak for leaving it out."""
    e = edge_counts(spark, sf_dir).withColumn("n2", F.col("n2") - 100_000_000).withColumn("n1", F.col("n1") + 200_000_000)
    e = e.withColumns({"count_fwd": F.when((F.col("count_fwd") >= 40) & (F.col("count_rev") >= 15), 9).otherwise(1).cast("long"), "count_rev": F.lit(9).cast("long")})
    own = e.select("locus", F.col("n2").alias("n1"), "n2", F.lit(9).cast("long").alias("count_fwd"), F.lit(9).cast("long").alias("count_rev")).distinct()
    return graph.isolated(e.unionByName(own))


@query(f"WITH {CLEAN} SELECT DISTINCT node FROM (SELECT n1 AS node FROM e UNION ALL SELECT n2 FROM e)")
def used_nodes(spark, sf_dir):
    """Nodes that still have an edge."""
    e = edge_counts(spark, sf_dir)
    return graph.without_empty_nodes(_nodes(e), graph.cleaned(e)).select("node")


@query(f"WITH {LINKS}, {ENDS.format(t='p')}, {_NODES}, m AS (SELECT node, node * 100 AS b, node * 100 + size AS e FROM n) SELECT node FROM m WHERE b < 150000 AND e > 5000")
def nodes_in_region(spark, sf_dir):
    """Nodes that touch a region."""
    return graph.in_region(_nodes(edge_counts(spark, sf_dir)), 0, 5000, 150_000).select("node")


@query(f"WITH {LINKS} SELECT n1, n2, count_fwd FROM p WHERE n1 = 7")
def edges_of_pair(spark, sf_dir):
    """Edges of a locus, by node."""
    return graph.of_locus(edge_counts(spark, sf_dir), 0).where("n1 = 7").select("n1", "n2", "count_fwd")


@query(f"""WITH {LINKS}, {ENDS.format(t='p')}, {_NODES}, l AS (SELECT n1 AS node, n2 || ':' || count_fwd || ':' || count_rev AS t FROM p UNION ALL SELECT n2, n1 || ':' || count_rev || ':' || count_fwd FROM p),
  g AS (SELECT node, string_agg(t, ' ' ORDER BY t) AS links FROM l GROUP BY node) SELECT 'locus 0 node ' || n.node || ' 0:[' || n.node * 100 || ',' || (n.node * 100 + size) || ') -> ' || links AS line FROM n JOIN g ON n.node = g.node""")
def graph_dump(spark, sf_dir):
    """A line for each node."""
    e = edge_counts(spark, sf_dir)
    return graph.dump(_nodes(e), e)


@query(f"""WITH {LINKS}, {ENDS.format(t='p')}, q AS (SELECT node, max(greatest(count_fwd, count_rev)) >= 9 AS signal FROM d GROUP BY node), b AS (SELECT node, signal, node * 100 AS b, node * 100 + 10 + node % 7 + (node % 11 = 0)::INT * 200 AS e FROM q WHERE node % 13 > 0),
  s AS (SELECT node, b, max(e) OVER (ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b WHERE signal)
  SELECT 'signal nodes overlap' AS fault, node FROM s WHERE b < seen UNION ALL SELECT 'edge without node', node FROM q WHERE node % 13 = 0""")
def graph_faults(spark, sf_dir):
    """What is wrong with a graph."""
    e = edge_counts(spark, sf_dir)
    n = _nodes(e).withColumn("end", F.col("end") + F.when(F.col("node") % 11 == 0, 200).otherwise(0)).where("node % 13 > 0")
    return graph.checks(n, e)


@query(f"""WITH {LINKS}, {ENDS.format(t='p')}, q AS (SELECT node FROM d GROUP BY node HAVING max(greatest(count_fwd, count_rev)) >= 9), b AS (SELECT node, node * 100 AS b, node * 100 + 10 + node % 7 + (node % 11 = 0)::INT * 300 AS e FROM q)
  SELECT x.node, y.node AS other FROM b x JOIN b y ON x.b < y.e AND y.b < x.e AND x.node < y.node""")
def overlapping_signal(spark, sf_dir):
    """Signal nodes that overlap."""
    e = edge_counts(spark, sf_dir)
    return graph.signal_neighbours(_nodes(e).withColumn("end", F.col("end") + F.when(F.col("node") % 11 == 0, 300).otherwise(0)), e)


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey % 5 AS t1, o_custkey AS b1, o_custkey + 8 AS e1, o_orderkey % 4 AS t2, o_orderkey % 900 AS b2, o_orderkey % 900 + 50 AS e2 FROM orders)
  SELECT x.id, y.id AS o_id FROM a x JOIN a y ON x.t1 = y.t1 AND x.b1 < y.e1 AND y.b1 < x.e1 AND x.t2 = y.t2 AND x.b2 < y.e2 AND y.b2 < x.e2 WHERE y.id % 3 = 0""")
def edge_pairs(spark, sf_dir):
    """Edges whose two ends both overlap."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    a = o.select(k.alias("id"), (c % 5).alias("t1"), c.alias("b1"), (c + 8).alias("e1"), (k % 4).alias("t2"), (k % 900).alias("b2"), (k % 900 + 50).alias("e2"))
    return support.edge_overlaps(a, a.where("id % 3 = 0"))


LOG = "lg AS (SELECT o_orderstatus AS kind, o_custkey AS candidates, o_custkey % 7 AS assembled, o_custkey % 3 AS scored, (o_orderkey % 1000) / 100.0 AS seconds, o_orderkey AS id FROM orders)"


def log_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("candidates"), (F.col("o_custkey") % 7).alias("assembled"), (F.col("o_custkey") % 3).alias("scored"), (F.col("o_orderkey") % 1000 / 100.0).alias("seconds"), F.col("o_orderkey").alias("id"))


@query(f"WITH {LOG} SELECT kind, count(*) AS edges, sum(candidates)::BIGINT AS candidates, sum(assembled)::BIGINT AS assembled, sum(scored)::BIGINT AS scored, round(sum(seconds), 2)::DOUBLE AS seconds FROM lg GROUP BY 1")
def edge_totals(spark, sf_dir):
    """Statistics of edges."""
    return support.edge_statistics(log_of(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


@query(f"WITH {LOG} SELECT id, seconds::DOUBLE AS seconds FROM lg WHERE seconds >= 0.5")
def slow_edge_log(spark, sf_dir):
    """Edges that took long."""
    return support.slow_edges(log_of(spark, sf_dir)).select("id", "seconds")


# partitions and headers


@query("""WITH r AS (SELECT n_name AS label, n_nationkey * 100 AS b, n_nationkey * 100 + 5000 AS e FROM nation), m AS (SELECT n_name AS chrom, c_custkey % 4000 AS b, c_custkey % 4000 + 20 AS e FROM customer JOIN nation ON n_nationkey = c_nationkey),
  o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m), i AS (SELECT *, sum((seen IS NULL OR b > seen)::INT) OVER (PARTITION BY chrom ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
  h AS (SELECT chrom, min(b) AS b, max(e) AS e FROM i GROUP BY chrom, k) SELECT label, greatest(r.b, h.b)::BIGINT AS "begin", least(r.e, h.e)::BIGINT AS "end" FROM r JOIN h ON label = chrom AND r.b < h.e AND h.b < r.e""")
def call_regions(spark, sf_dir):
    """The parts of regions that lie in a table of ranges."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    r = n.select(F.col("n_name").alias("label"), (F.col("n_nationkey").cast("long") * 100).alias("begin"), (F.col("n_nationkey").cast("long") * 100 + 5000).alias("end"))
    bed = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("chrom"), (F.col("c_custkey") % 4000).cast("long").alias("begin"), (F.col("c_custkey") % 4000 + 20).cast("long").alias("end"))
    return partitioning.callable_regions(r, bed)


@query("SELECT n_name AS label FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 12)")
def skipped_contigs(spark, sf_dir):
    """Contigs without a callable range."""
    n = table(spark, sf_dir, "nation")
    bed = table(spark, sf_dir, "supplier").where("s_suppkey <= 12").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("chrom"))
    return partitioning.skipped_contigs(n.select(F.col("n_name").alias("label")), bed)


@query("""SELECT n_nationkey::INT AS tid, n_name AS label, (n_nationkey % 3)::INT AS length, 'left' AS side FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_nationkey::INT, n_name, 0, 'right' FROM nation WHERE n_nationkey % 3 = 1
  UNION ALL SELECT n_nationkey::INT, n_name, 2, 'left' FROM nation WHERE n_nationkey % 3 = 2""")
def header_differences(spark, sf_dir):
    """Contigs that two headers do not share."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("tid"), F.col("n_name").alias("label"), (F.col("n_nationkey") % 3).cast("int").alias("length"))
    return partitioning.contig_mismatches(n, n.where("length < 2").withColumn("length", F.lit(0)))


@query("SELECT o_orderkey, o_orderstatus AS sample FROM orders WHERE o_orderstatus IN ('F', 'O')")
def sample_streams(spark, sf_dir):
    """S3: alignments of several samples as one table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") % 5).alias("tid"), F.col("o_orderkey").alias("pos0"), F.col("o_orderkey").alias("qname"))
    return partitioning.merged_streams(o.where("sample = 'F'"), o.where("sample = 'O'")).select("o_orderkey", "sample")


# sequences and paths


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ACG' WHEN p_partkey % 3 = 1 THEN 'A' ELSE repeat('CA', (p_size % 4 + 1)::INT) || 'T' END AS unit FROM part")
def repeat_units(spark, sf_dir):
    """Q2: the shortest unit that a sequence repeats."""
    p, n = table(spark, sf_dir, "part"), (F.col("p_size") % 4 + 1).cast("int")
    s = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit("ACG"), n)).when(F.col("p_partkey") % 3 == 1, F.repeat(F.lit("A"), n)).otherwise(F.concat(F.repeat(F.lit("CA"), n), F.lit("T")))
    return p.select("p_partkey", seq.repeat_unit(s).alias("unit"))


@query(f"""WITH {ALIGNMENTS} SELECT qname, (l_linenumber + match)::VARCHAR || 'M' || del || 'D20M' AS matched, (pos0 - l_linenumber)::INT AS start, (match - 5)::VARCHAR || 'M' || del || 'D7M' AS of_read, (match - 9)::VARCHAR || 'M' || CASE WHEN del > 1 THEN (del - 1) || 'D' ELSE '' END AS of_ref FROM a""")
def path_limits(spark, sf_dir):
    """Q5, Q7: parts of paths by read and reference places, and soft clips as matches."""
    a = alignments(spark, sf_dir).withColumn("path", cigar.parse(F.col("cigar")))
    lead = cigar.clip_lead(F.col("path"))
    match = F.get("path", F.lit(1))["len"]
    gap = F.get("path", F.lit(2))["len"]
    return a.select("qname", cigar.text(cigar.matchified(F.col("path"))).alias("matched"), cigar.matchified_start(F.col("pos0"), F.col("path")).cast("int").alias("start"), cigar.text(cigar.limited_to_read(F.col("path"), lead + 5, lead + match + 7)).alias("of_read"), cigar.text(cigar.limited_to_ref(F.col("path"), F.lit(9), match + gap - 1)).alias("of_ref"))


# support and models


@query("""WITH h AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1), c AS (SELECT size, sum(n) OVER (ORDER BY size) / sum(n) OVER () AS share, lead(size) OVER (ORDER BY size) AS ahead FROM h)
  SELECT s_suppkey, round(coalesce((SELECT least(share, 1 - share) FROM c WHERE size <= s_suppkey % 70 AND s_suppkey % 70 < coalesce(ahead, size + 1)), 0)::DOUBLE, 9) AS chance FROM supplier""")
def fragment_chances(spark, sf_dir):
    """How likely fragment sizes are."""
    h = table(spark, sf_dir, "part").groupBy(F.lit(0).alias("sample"), F.col("p_size").cast("long").alias("size")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0).alias("sample"), (F.col("s_suppkey") % 70).cast("long").alias("fragment"))
    return support.with_probability(s, support.size_shares(h), "fragment", "chance").select("s_suppkey", F.round("chance", 9).alias("chance"))


def evidence_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("ref_pair"), F.col("l_tax").alias("alt_pair"), (F.col("l_partkey") % 1500).alias("size"), (F.col("l_suppkey") % 4 == 0).alias("imprecise"), F.lit(True).alias("r1_split"), F.lit(False).alias("r2_split"),
        (-F.col("l_quantity")).alias("r1_ref_lnl"), (-F.col("l_linenumber") * 5.0).alias("r1_alt_lnl"), F.lit(0.0).alias("r2_ref_lnl"), F.lit(0.0).alias("r2_alt_lnl"),
    )


@query("""WITH x AS (SELECT *, l_discount > l_tax AND -l_linenumber * 5.0 > -l_quantity OR l_tax > l_discount AND l_partkey % 1500 <= 1000 AND -l_quantity > -l_linenumber * 5.0 AS against FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_suppkey % 4 > 0 AND against) THEN l_discount END AS ref_pair, CASE WHEN NOT (l_suppkey % 4 > 0 AND against) THEN l_tax END AS alt_pair FROM x""")
def pair_conflicts(spark, sf_dir):
    """Pair support that split reads of the fragment speak against."""
    return scoring.resolved_conflicts(evidence_rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", "ref_pair", "alt_pair")


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN greatest(0, least(1, (o_orderkey % 200 - 100) / 50.0)) WHEN o_orderkey % 4 < 2 THEN greatest(0, least(1, (o_orderkey % 700 - 300) / 200.0)) ELSE 1 END, 9)::DOUBLE AS weight,
  round(CASE WHEN o_custkey % 2 = 0 THEN greatest(0, least(1, (o_custkey * 10 - 5000) / 5000.0)) ELSE 1 END, 9)::DOUBLE AS noise FROM orders""")
def pair_weights(spark, sf_dir):
    """How far pairs count for small events, and how far the prior of large noise does."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "INSERT").when(k % 4 == 1, "DELETE").otherwise("TANDUP")
    w = scoring.pair_weight(k % 700, kind, k % 3 == 0, k % 200)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(w.cast("double"), 9).alias("weight"), F.round(scoring.large_noise_weight(F.col("o_custkey") * 10, F.col("o_custkey") % 2 == 0), 9).alias("noise"))


def judged(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        (k % 500).alias("event"), k.alias("junction"), (k % 40).cast("double").alias("bp1_depth"), (k % 60).cast("double").alias("bp2_depth"), F.lit(30.0).alias("bp1_limit"), F.lit(45.0).alias("bp2_limit"), (k % 10 / 10.0).alias("bp1_mq0"), F.lit(0.1).alias("bp2_mq0"), (k % 3000).alias("size"),
        F.when(k % 3 == 0, "INSERT").otherwise("DELETE").alias("kind"), (k % 2).alias("spanning"), (k % 2 == 0).alias("imprecise"), (k % 5 > 0).alias("same_contig"), (k % 4).alias("split"),
    )


JUDGED = """j AS (SELECT o_orderkey % 500 AS event, o_orderkey AS k, o_orderkey % 40 > 30 OR o_orderkey % 60 > 45 AS deep, o_orderkey % 3000 < 1000 AND (o_orderkey % 10 / 10.0 > 0.4) AS mq0, o_orderkey % 3 > 0 AND o_orderkey % 3000 >= 1000 AND o_orderkey % 2 = 0 AS alone FROM orders),
  jl AS (SELECT event, CASE WHEN count(*) FILTER (deep) * 2 > count(*) THEN ['MaxDepth'] ELSE [] END || CASE WHEN count(*) FILTER (mq0) * 2 > count(*) THEN ['MaxMQ0Frac'] ELSE [] END AS two, CASE WHEN count(*) FILTER (alone) * 2 > count(*) THEN ['NoPairSupport'] ELSE [] END AS three FROM j GROUP BY event)"""


@query(f"WITH {JUDGED} SELECT event, array_to_string(two, ',') AS filters FROM jl")
def tumour_labels(spark, sf_dir):
    """Filters of tumour-only events."""
    return scoring.tumour_filters(judged(spark, sf_dir)).select("event", F.array_join("filters", ",").alias("filters"))


@query("""SELECT o_orderkey AS junction, 42 AS score, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN ['Imprecise'] ELSE [] END || CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3000 < 100000 THEN ['Local'] ELSE [] END
  || CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 2 = 0 THEN ['LowEvidence'] ELSE [] END, ',') AS filters FROM orders""")
def rna_labels(spark, sf_dir):
    """C20: filters of RNA events."""
    return scoring.rna_filters(judged(spark, sf_dir), ("junction",)).select("junction", "score", F.array_join("filters", ",").alias("filters"))


def called(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    gt = F.when(k % 3 == 0, "REF").when(k % 3 == 1, "HET").otherwise("HOM")
    return o.select((k % 500).alias("event"), k.alias("sample"), gt.alias("gt"), (k % 31).cast("int").alias("gq"), ((k % 97 + 1) / 100.0).alias("p_ref"))


@query(f"""WITH {JUDGED}, c AS (SELECT o_orderkey % 500 AS event, o_orderkey % 3 = 0 OR o_orderkey % 31 < 15 AS bad, (o_orderkey % 97 + 1) / 100.0 AS p FROM orders), q AS (SELECT event, bool_and(bad) AS all_bad, least(999, floor(-10 * log10(exp(sum(ln(p)))) + 0.5)::INT) AS qual FROM c GROUP BY event)
  SELECT q.event, qual, array_to_string(list_sort(CASE WHEN qual < 20 THEN ['MinQUAL'] ELSE [] END || CASE WHEN all_bad THEN ['SampleFT'] ELSE [] END || two || three), ',') AS filters FROM q JOIN jl ON q.event = jl.event""")
def diploid_labels(spark, sf_dir):
    """C17: quality and filters of germline events."""
    return scoring.diploid_filters(called(spark, sf_dir), judged(spark, sf_dir)).select("event", "qual", F.array_join("filters", ",").alias("filters"))


@query("WITH g AS (SELECT o_orderkey % 500 AS event, o_orderkey % 4 AS sample, max((o_orderkey % 97 + 1) / 100.0) - min((o_orderkey % 97 + 1) / 100.0) AS gap FROM orders GROUP BY 1, 2) SELECT event, bool_and(gap <= 0.905) AS consistent FROM g GROUP BY 1")
def genotype_agreement(spark, sf_dir):
    """Whether an event's junctions agree."""
    return scoring.consistent_genotypes(called(spark, sf_dir).withColumn("sample", F.col("sample") % 4), most=0.905)


@query("""WITH s AS (SELECT o_orderkey % 500 AS event, o_orderkey AS junction, o_orderkey % 50 AS own FROM orders), b AS (SELECT *, max(own) OVER (PARTITION BY event) AS best, event % 60 AS joint FROM s)
  SELECT junction, joint >= best AS is_joint, CASE WHEN joint >= best THEN joint ELSE own END AS score, CASE WHEN joint >= best THEN joint >= 30 ELSE own >= 30 END AS written FROM b""")
def event_routes(spark, sf_dir):
    """Which score counts, and what is written."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 500).alias("event"), F.col("o_orderkey").alias("junction"), (F.col("o_orderkey") % 50).alias("score"))
    joint = o.select("event").distinct().withColumn("score", F.col("event") % 60)
    return scoring.routed(o.select("event", "junction"), joint, o, F.lit(30)).select("junction", "is_joint", "score", "written")


@query(f"""WITH {SPANS}, b AS (SELECT event_id AS id, tid, "begin" + 500 AS center FROM s WHERE event_type = 'purchase'), h AS (SELECT b.id, greatest(s."begin", center - 3000) AS lo, least(s."end", center + 3001) AS hi, event_id % 4 = 0 AS zero FROM b JOIN s ON s.tid = b.tid AND s."begin" < center + 3001 AND center - 3000 < s."end"),
  p AS (SELECT x.id, max(n) AS peak FROM (SELECT a.id, a.lo, count(*) AS n FROM h a JOIN h c ON a.id = c.id AND c.lo <= a.lo AND a.lo < c.hi GROUP BY a.id, a.lo, a.hi) x GROUP BY x.id), f AS (SELECT id, CASE WHEN count(*) >= 3 THEN count(*) FILTER (zero) / count(*) ELSE 0 END AS mq0 FROM h GROUP BY id)
  SELECT b.id, coalesce(peak, 0)::BIGINT AS max_depth, round(coalesce(mq0, 0), 9)::DOUBLE AS mq0 FROM b LEFT JOIN p ON b.id = p.id LEFT JOIN f ON b.id = f.id""")
def breakend_depths(spark, sf_dir):
    """The depth about breakends, and the share of reads without mapping quality."""
    s = spans(spark, sf_dir)
    b = s.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "tid", (F.col("begin") + 500).alias("center"))
    d = scoring.breakend_depth(s.select("tid", "begin", "end", (F.col("event_id") % 4).alias("mapq")), b, pad=3000, least=3)
    return d.withColumn("mq0", F.round("mq0", 9))


# records


def pairs_of(spark, sf_dir):
    """Orders as breakend pairs."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("e"), k.cast("string")).alias("id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("chrom1"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("chrom2"), (k % 900).alias("pos1"), (k % 900 + 1 + k % 5).alias("end1"), (k % 700 + 2000).alias("pos2"), (k % 700 + 2001 + k % 5).alias("end2"),
        (k % 2 + 1).cast("int").alias("state1"), (F.floor(k / 2) % 2 + 1).cast("int").alias("state2"), F.lit("A").alias("ref1"), F.lit("C").alias("ref2"), F.when(k % 6 == 0, "GAT").otherwise("").alias("insert_seq"), (k % 7 == 0).alias("imprecise"), F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filter"),
    )


@query("""WITH x AS (SELECT o_orderkey AS k, 'e' || o_orderkey AS id, 'c' || o_orderkey % 3 AS h1, 'c' || o_orderkey % 4 AS h2, o_orderkey % 900 AS p1, o_orderkey % 700 + 2000 AS p2, o_orderkey % 5 AS w, o_orderkey % 2 + 1 AS s1, o_orderkey // 2 % 2 + 1 AS s2, CASE WHEN o_orderkey % 6 = 0 THEN 'GAT' ELSE '' END AS ins, o_orderkey % 7 = 0 AS im FROM orders),
  b AS (SELECT *, 0 AS n, h1 AS h, p1 AS p, s1 AS s, 'A' AS r, h2 AS mh, p2 AS mp, s2 AS ms FROM x UNION ALL SELECT *, 1, h2, p2, s2, 'C', h1, p1, s1 FROM x),
  c AS (SELECT *, CASE WHEN im THEN w // 2 ELSE 0 END AS sh, CASE WHEN s1 = s2 AND n = 1 THEN reverse(translate(ins, 'ACGT', 'TGCA')) ELSE ins END AS t FROM b),
  d AS (SELECT *, CASE WHEN ms = 1 THEN ']' || mh || ':' || (mp + sh + 1) || ']' ELSE '[' || mh || ':' || (mp + sh + 1) || '[' END AS br FROM c)
  SELECT h AS chrom, (p + sh + 1)::INT AS pos, id || ':' || n AS id, r AS ref, CASE WHEN s = 1 THEN r || t || br ELSE br || t || r END AS alt,
    'SVTYPE=BND;MATEID=' || id || ':' || (1 - n) || CASE WHEN im THEN ';IMPRECISE;CIPOS=' || -sh || ',' || (w - sh) WHEN w > 0 THEN ';CIPOS=0,' || w || ';HOMLEN=' || w ELSE '' END || CASE WHEN ins <> '' THEN ';SVINSLEN=3;SVINSSEQ=GAT' ELSE '' END AS info FROM d""")
def breakend_records(spark, sf_dir):
    """Two records for each breakend pair."""
    return vcf.breakend_rows(pairs_of(spark, sf_dir)).select("chrom", "pos", "id", "ref", "alt", "info")


@query("""WITH x AS (SELECT o_orderkey AS k, o_orderkey % 900 AS p, o_orderkey % 1500 AS size, CASE WHEN o_orderkey % 3 = 0 THEN 'DELETE' WHEN o_orderkey % 3 = 1 THEN 'INSERT' ELSE 'TANDUP' END AS kind, CASE WHEN o_orderkey % 3 = 1 THEN repeat('G', (o_orderkey % 20)::INT) ELSE '' END AS ins, o_orderkey % 4 = 0 AS im, CASE WHEN o_orderkey % 5 = 0 THEN 'TT' ELSE '' END AS hom FROM orders),
  y AS (SELECT *, CASE WHEN kind = 'INSERT' THEN 0 ELSE size END AS d FROM x), z AS (SELECT *, greatest(d, length(ins)) <= 1000 AND NOT im AND kind <> 'TANDUP' AS small FROM y)
  SELECT 'o' || k AS id, (p + 1)::INT AS pos, CASE WHEN small THEN 'A' || repeat('C', d::INT) ELSE 'A' END AS ref, CASE WHEN small THEN 'A' || ins WHEN kind = 'DELETE' THEN '<DEL>' WHEN kind = 'INSERT' THEN '<INS>' ELSE '<DUP:TANDEM>' END AS alt,
    'END=' || CASE WHEN kind = 'INSERT' THEN p + 1 ELSE p + 1 + d END || ';SVTYPE=' || CASE kind WHEN 'DELETE' THEN 'DEL' WHEN 'INSERT' THEN 'INS' ELSE 'DUP' END || CASE WHEN kind = 'DELETE' THEN ';SVLEN=' || -d WHEN kind = 'TANDUP' THEN ';SVLEN=' || d WHEN ins <> '' THEN ';SVLEN=' || length(ins) ELSE '' END
    || CASE WHEN small THEN ';CIGAR=1M' || CASE WHEN ins <> '' THEN length(ins) || 'I' ELSE '' END || CASE WHEN d > 0 THEN d || 'D' ELSE '' END ELSE '' END || CASE WHEN im THEN ';IMPRECISE' ELSE '' END || CASE WHEN hom <> '' THEN ';HOMLEN=2;HOMSEQ=TT' ELSE '' END AS info FROM z""")
def indel_records(spark, sf_dir):
    """Records of deletions, insertions and duplications."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "DELETE").when(k % 3 == 1, "INSERT").otherwise("TANDUP")
    size = F.when(k % 3 == 1, 0).otherwise(k % 1500)
    e = o.select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"), kind.alias("kind"), F.lit("c1").alias("chrom"), (k % 900).alias("pos"), (k % 900 + 1 + size).alias("end"), F.concat(F.lit("A"), F.repeat(F.lit("C"), size.cast("int"))).alias("ref"), F.when(k % 3 == 1, F.repeat(F.lit("G"), (k % 20).cast("int"))).otherwise("").alias("insert_seq"), (k % 4 == 0).alias("imprecise"),
        F.when(k % 5 == 0, "TT").otherwise("").alias("homology"), F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filter"),
    )
    return vcf.indel_rows(e).select("id", "pos", "ref", "alt", "info")


@query("""WITH s AS (SELECT o_orderkey % 300 AS id, o_orderkey AS sample, CASE o_orderkey % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'PASS' ELSE 'MinGQ' END || ':' || o_orderkey % 31 || ':0,' || o_orderkey % 9 || ',5:' || o_orderkey % 4 || ',' || o_orderkey % 5 || ':' || o_orderkey % 6 || ',1' AS t FROM orders)
  SELECT id::VARCHAR AS id, 'GT:FT:GQ:PL:PR:SR' AS format, string_agg(t, ' ' ORDER BY sample) AS samples FROM s GROUP BY id""")
def sample_fields(spark, sf_dir):
    """Sample fields of germline records."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    s = o.select((k % 300).cast("string").alias("id"), k.alias("sample"), F.when(k % 3 == 0, "REF").when(k % 3 == 1, "HET").otherwise("HOM").alias("gt"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("MinGQ"))).alias("ft"), (k % 31).alias("gq"), F.array(F.lit(0), (k % 9).cast("int"), F.lit(5)).alias("pl"), (k % 4).alias("ref_spanning"), (k % 5).alias("alt_spanning"), (k % 6).alias("ref_split"), F.lit(1).alias("alt_split"))
    return vcf.with_samples(s.select("id").distinct(), s, "diploid").select("id", "format", F.array_join("samples", " ").alias("samples"))


@query("""WITH x AS (SELECT o_orderkey AS k, 'c' || o_orderkey % 3 AS chrom, o_custkey AS p, o_custkey + o_orderkey % 80 + 1 AS q, o_orderkey % 2 = 0 AS five FROM orders WHERE o_orderkey % 3 > 0)
  SELECT 'i' || k AS id, chrom, (p - five::INT)::INT AS pos, '<INV>' AS alt, 'END=' || (q - five::INT) || ';SVTYPE=INV;SVLEN=' || (q - p) || CASE WHEN five THEN ';INV5' ELSE ';INV3' END || ';X=1' AS info FROM x
  UNION ALL SELECT 'i' || o_orderkey, 'c0', o_custkey::INT, '<DEL>', 'SVTYPE=DEL' FROM orders WHERE o_orderkey % 3 = 0""")
def inversion_records(spark, sf_dir):
    """Breakend pairs that face the same way as inversions."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    chrom, p = F.concat(F.lit("c"), (k % 3).cast("string")), F.col("o_custkey")
    q = p + k % 80 + 1
    ident = F.concat(F.lit("i"), k.cast("string"))
    alt = lambda at: F.when(k % 2 == 0, F.concat(F.lit("["), chrom, F.lit(":"), at.cast("string"), F.lit("[A"))).otherwise(F.concat(F.lit("A]"), chrom, F.lit(":"), at.cast("string"), F.lit("]")))
    side = lambda n, here, there: o.where("o_orderkey % 3 > 0").select(F.concat(ident, F.lit(f":{n}")).alias("id"), chrom.alias("chrom"), here.cast("int").alias("pos"), F.lit("A").alias("ref"), alt(there).alias("alt"), F.concat(F.lit("SVTYPE=BND;MATEID="), ident, F.lit(f":{1 - n};X=1")).alias("info"))
    rest = o.where("o_orderkey % 3 = 0").select(ident.alias("id"), chrom.alias("chrom"), p.cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("<DEL>").alias("alt"), F.lit("SVTYPE=DEL").alias("info"))
    return vcf.inversions(side(0, p, q).unionByName(side(1, q, p)).unionByName(rest)).select("id", "chrom", "pos", "alt", "info")


@query("""WITH x AS (SELECT 'v' || o_orderkey AS id, o_orderkey AS k, 'c' || o_custkey % 3 AS chrom, o_orderkey % 90000 AS pos, o_orderkey % 90000 + o_custkey % 50 * 10 AS stop FROM orders)
  SELECT id FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.chrom = a.chrom AND abs(b.pos - a.pos) <= 20 AND abs(b.stop - a.stop) <= 20 AND (b.pos < a.pos OR (b.pos = a.pos AND b.id < a.id)))""")
def near_inversions(spark, sf_dir):
    """Inversions whose ends lie near each other as one."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    r = o.select(F.concat(F.lit("v"), k.cast("string")).alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("chrom"), (k % 90_000).cast("int").alias("pos"), F.lit("A").alias("ref"), F.concat(F.lit("SVTYPE=INV;END="), (k % 90_000 + F.col("o_custkey") % 50 * 10).cast("string")).alias("info"))
    return vcf.merged_inversions(r, 20).select("id")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 60 < 30 THEN 'MinSomaticScore,X' ELSE 'X' END AS filters FROM orders")
def score_labels(spark, sf_dir):
    """Somatic score labels set anew."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    r = o.select(k.alias("k"), F.concat(F.lit("SOMATIC;SOMATICSCORE="), (k % 60).cast("string")).alias("info"), F.when(k % 2 == 0, F.array(F.lit("X"), F.lit("MinSomaticScore"))).otherwise(F.array(F.lit("X"))).alias("filter"))
    return vcf.refiltered(r, 30).select("k", F.array_join("filter", ",").alias("filters"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS n, 'V' || l_suppkey % 20 AS sv, CASE WHEN l_partkey % 2 = 0 THEN 'PR' ELSE 'SR' END AS kind FROM lineitem UNION SELECT l_orderkey, l_linenumber, 'V3', 'PR' FROM lineitem WHERE l_linenumber = 1),
  o AS (SELECT q, n, sv, string_agg(kind, '|' ORDER BY kind) AS kinds FROM s GROUP BY 1, 2, 3), z AS (SELECT q, n, string_agg(sv || '|' || kinds, ',' ORDER BY sv || '|' || kinds) AS zm, bool_or(sv IN ('V3', 'V7')) AS wanted FROM o GROUP BY 1, 2) SELECT q AS qname, n AS read_no, zm FROM z WHERE wanted""")
def evidence_reads(spark, sf_dir):
    """Reads tagged with what they support, and those of chosen ids."""
    l = table(spark, sf_dir, "lineitem")
    r = l.select(F.lit(0).alias("sample"), F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("read_no"), F.lit(0).alias("tid"), F.lit(0).alias("pos0"), F.col("l_partkey").alias("p"), F.concat(F.lit("V"), (F.col("l_suppkey") % 20).cast("string")).alias("sv"))
    s = r.withColumn("kind", F.when(F.col("p") % 2 == 0, "PR").otherwise("SR")).unionByName(r.where("read_no = 1").withColumns({"sv": F.lit("V3"), "kind": F.lit("PR")}))
    tagged = vcf.supporting_reads(r.drop("p", "sv").distinct(), s)
    return vcf.reads_of(tagged, spark.createDataFrame([("V3",), ("V7",)], "id string")).select("qname", "read_no", "zm")


# sampling and pair support


_Q = "SELECT sample, p, min(size) AS size FROM (SELECT sample, size, round_even(sum(n) OVER (PARTITION BY sample ORDER BY size) * 1000 / sum(n) OVER (PARTITION BY sample), 0) AS reached FROM {t}) JOIN (SELECT unnest([0.1, 0.5, 0.9]) AS p) ON reached >= ceil(p * 1000 - 1e-9) GROUP BY 1, 2"


@query(f"""WITH h AS (SELECT l_suppkey % 20 AS sample, l_quantity::BIGINT AS size, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey % 20 AS sample, l_quantity::BIGINT AS size, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
  a AS ({_Q.format(t="h")}), b AS ({_Q.format(t="g")}) SELECT a.sample, bool_and(abs(a.size - b.size) <= 2) AS converged FROM a JOIN b ON a.sample = b.sample AND a.p = b.p GROUP BY 1""")
def quantile_convergence(spark, sf_dir):
    """Whether a part of the fragments tells the same quantiles as all do."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("sample"), F.col("l_quantity").cast("long").alias("size"), "l_linenumber")
    of = lambda df: stats.quantiles(stats.size_cdf(df.groupBy("sample", "size").agg(F.count("*").alias("n")), ["sample"]), ["sample"], (0.1, 0.5, 0.9))
    return stats.converged(of(l), of(l.where("l_linenumber <= 3")), ["sample"], 2)


@query("""WITH h AS (SELECT (l_linenumber * 50 + 60)::BIGINT AS size, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT size, sum(n) OVER (ORDER BY size) / sum(n) OVER () AS share, lead(size) OVER (ORDER BY size) AS ahead FROM h),
  f AS (SELECT l_orderkey || '/' || l_linenumber AS qname, l_suppkey % 3 AS tid, l_partkey AS pos, (100 + l_suppkey % 300)::BIGINT AS size FROM lineitem), j AS (SELECT s_suppkey AS junction, s_suppkey % 3 AS tid, s_suppkey * 37 % 2000 AS c1, s_suppkey * 37 % 2000 + s_suppkey % 900 AS c2 FROM supplier),
  u AS (SELECT junction, tid, c1 AS c FROM j UNION ALL SELECT junction, (tid + junction % 2) % 3, c2 FROM j),
  m AS (SELECT DISTINCT junction, qname, size FROM f JOIN u ON f.tid = u.tid AND pos + 50 <= c AND c < pos + size - 50 WHERE size BETWEEN 120 AND 350)
  SELECT junction, qname, round(coalesce((SELECT least(share, 1 - share) FROM c WHERE c.size <= m.size AND m.size < coalesce(ahead, c.size + 1)), 0)::DOUBLE, 9) AS ref_pair FROM m""")
def reference_pairs(spark, sf_dir):
    """Proper pairs that hold a breakend with enough bases on both sides."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    shares = support.size_shares(l.groupBy(F.lit(0).alias("sample"), (F.col("l_linenumber") * 50 + 60).cast("long").alias("size")).agg(F.count("*").alias("n")))
    size = (100 + F.col("l_suppkey") % 300).cast("long")
    pairs = l.select(
        F.lit(0).alias("sample"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), F.lit(120).alias("pp_min"), F.lit(350).alias("pp_max"), *[(F.col("l_suppkey") % 3).alias(f"tid{k}") for k in (1, 2)], F.col("l_partkey").alias("pos1"), (F.col("l_partkey") + 50).alias("end1"), (F.col("l_partkey") + size - 50).alias("pos2"), (F.col("l_partkey") + size).alias("end2"),
        F.lit(True).alias("fwd1"), F.lit(False).alias("fwd2"), F.lit(60).alias("mapq1"), F.lit(60).alias("mapq2"),
    )
    k = F.col("s_suppkey")
    found = s.select(F.lit("e").alias("event"), k.alias("junction"), (k % 3).alias("b_tid1"), ((k % 3 + k % 2) % 3).alias("b_tid2"), (k * 37 % 2000).alias("c1"), (k * 37 % 2000 + k % 900).alias("c2"))
    return support.ref_pairs(found, pairs, shares).select("junction", "qname", F.round("ref_pair", 9).alias("ref_pair"))


@query("""WITH f AS (SELECT l_orderkey || '/' || l_linenumber AS qname, l_suppkey % 3 AS tid, l_partkey AS pos, l_partkey + 300 + l_suppkey % 700 AS pos2 FROM lineitem), j AS (SELECT s_suppkey AS junction, s_suppkey % 3 AS tid, s_suppkey * 37 % 2000 AS b1, s_suppkey * 37 % 2000 + 400 AS b2 FROM supplier),
  m AS (SELECT junction, qname, (b1 + 19 - pos) + (pos2 + 50 - (b2 + 19)) AS size FROM f JOIN j ON f.tid = j.tid AND pos + 50 < b1 + 40 AND b1 < pos + 50 + 300 + 1 AND pos2 > b2 AND pos2 - 300 <= b2 + 40)
  SELECT junction, qname, size::BIGINT AS alt_size FROM m""")
def alternative_pairs(spark, sf_dir):
    """Pairs whose reads point at both breakends, and the size that the junction gives them."""
    l, s, k = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    shares = support.size_shares(l.groupBy(F.lit(0).alias("sample"), (F.col("l_linenumber") * 50).cast("long").alias("size")).agg(F.count("*").alias("n")))
    pos2 = F.col("l_partkey") + 300 + F.col("l_suppkey") % 700
    pairs = l.select(
        F.lit(0).alias("sample"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), F.lit(300).alias("pp_max"), *[(F.col("l_suppkey") % 3).alias(f"tid{i}") for i in (1, 2)], F.col("l_partkey").alias("pos1"), (F.col("l_partkey") + 50).alias("end1"), pos2.alias("pos2"), (pos2 + 50).alias("end2"),
        F.lit(True).alias("fwd1"), F.lit(False).alias("fwd2"), F.lit(60).alias("mapq1"), F.lit(60).alias("mapq2"),
    )
    b1 = k * 37 % 2000
    found = s.select(F.lit("e").alias("event"), k.alias("junction"), *[(k % 3).alias(f"b_tid{i}") for i in (1, 2)], b1.alias("b_begin1"), (b1 + 40).alias("b_end1"), (b1 + 400).alias("b_begin2"), (b1 + 440).alias("b_end2"), F.lit(1).alias("b_state1"), F.lit(2).alias("b_state2"), (b1 + 19).alias("c1"), (b1 + 419).alias("c2"))
    return support.alt_pairs(found, pairs, shares).select("junction", "qname", "alt_size")


@query("""WITH a AS (SELECT l_orderkey AS qname, l_linenumber % 2 + 1 AS read_no, l_suppkey % 5 AS mate_tid, l_partkey AS mate_pos FROM lineitem WHERE l_linenumber = 1),
  r AS (SELECT l_orderkey AS qname, l_linenumber AS read_no, l_suppkey % 5 AS tid, l_partkey AS pos, l_tax < 0.05 AS zero FROM lineitem WHERE l_linenumber <= 2)
  SELECT DISTINCT r.qname, r.read_no, r.tid, r.pos AS pos0 FROM r JOIN a ON r.qname = a.qname AND r.read_no = 3 - a.read_no WHERE zero AND EXISTS (SELECT 1 FROM a x WHERE x.mate_tid = r.tid AND greatest(0, x.mate_pos - 5) <= r.pos AND r.pos < x.mate_pos + 5)""")
def remote_mates(spark, sf_dir):
    """Mates of anchors, fetched over their merged regions."""
    l = table(spark, sf_dir, "lineitem")
    a = l.where("l_linenumber = 1").select(F.lit(0).alias("sample"), F.col("l_orderkey").alias("qname"), (F.col("l_linenumber") % 2 + 1).alias("read_no"), (F.col("l_suppkey") % 5).alias("mate_tid"), F.col("l_partkey").alias("mate_pos0"))
    r = l.where("l_linenumber <= 2").select(F.lit(0).alias("sample"), F.col("l_orderkey").alias("qname"), (F.col("l_linenumber") == 2).alias("is_second"), (F.col("l_suppkey") % 5).alias("tid"), F.col("l_partkey").alias("pos0"), F.when(F.col("l_tax") < 0.05, 0).otherwise(9).alias("mapq"))
    return support.remote_reads(r, a, 5).select("qname", "read_no", "tid", "pos0").distinct()


@query("""SELECT n_name AS label, (2000000 * pow(2, greatest(0, ceil(log2(greatest((n_nationkey * n_nationkey + 1) * 1000003, 1) / 40000000.0)))))::BIGINT AS size FROM nation""")
def depth_sampling(spark, sf_dir):
    """The size of the segments that a contig's depth is sampled by; one row for each contig."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # the table of contigs is small
    return spark.createDataFrame([(r.n_name, partitioning.depth_segments((r.n_nationkey**2 + 1) * 1_000_003)) for r in rows], "label string, size long")
