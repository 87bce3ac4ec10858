"""Candidates: clusters of observations per edge, their types, tests and groups of junctions.

Clustering depends on the order of fragments, so it runs as one function over the observations of an edge, in
order of place; an edge's fragments are bounded by the caps of the search. Everything else is column expressions.
"""

from __future__ import annotations

from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prob
from ..schema import COMPLEX, LEFT_OPEN, RIGHT_OPEN
from . import intervals

#: Most fragments of an edge that are clustered; of more, those with the least hashes of their names, a fixed choice that favours no place.
MAX_FRAGMENTS = 4000
COMPLEX_ALPHA, SPANNING_ALPHA = 0.005, 0.03


def is_spanning() -> Column:
    open_ = lambda c: F.col(c).isin(RIGHT_OPEN, LEFT_OPEN)
    return open_("bp1_state") & open_("bp2_state")


def is_complex() -> Column:
    return F.col("bp1_state") == COMPLEX


def center_size() -> Column:
    """Bases between the breakends' centres."""
    c1 = intervals.center(F.col("bp1_begin"), F.col("bp1_end"))
    c2 = intervals.center(F.col("bp2_begin"), F.col("bp2_end"))
    return F.abs(c2 - c1) - 1


def below_size(least: int, insert_size: Column | None = None) -> Column:
    """Same-contig candidates with fewer bases between or inserted than the least."""
    inserted = F.lit(0) if insert_size is None else insert_size
    return (F.col("bp1_tid") == F.col("bp2_tid")) & (F.greatest(center_size(), inserted) < least)


def sv_type() -> Column:
    """INTERTRANSLOC, INVERSION, INDEL (innies), TANDUP (outties), COMPLEX or UNKNOWN."""
    first_left = F.col("bp1_begin") <= F.col("bp2_begin")
    left, right = F.when(first_left, F.col("bp1_state")).otherwise(F.col("bp2_state")), F.when(first_left, F.col("bp2_state")).otherwise(F.col("bp1_state"))
    return (
        F.when(is_complex(), "COMPLEX")
        .when(F.col("bp1_tid") != F.col("bp2_tid"), "INTERTRANSLOC")
        .when(F.col("bp1_state") == F.col("bp2_state"), "INVERSION")
        .when((left == RIGHT_OPEN) & (right == LEFT_OPEN), "INDEL")
        .when((left == LEFT_OPEN) & (right == RIGHT_OPEN), "TANDUP")
        .otherwise("UNKNOWN")
    )


def extended_type(insert_size: Column, force_bnd: Column | bool = False) -> Column:
    """INSERT or DELETE of indels, by the larger of the two sizes (a tie is DELETE)."""
    kind = sv_type()
    out = F.when(kind == "INDEL", F.when(insert_size > F.greatest(center_size(), F.lit(0)), "INSERT").otherwise("DELETE")).otherwise(kind)
    return F.when(F.lit(force_bnd) if isinstance(force_bnd, bool) else force_bnd, "INTERTRANSLOC").otherwise(out)


def is_cis() -> Column:
    """Breakends on one contig that read on in one direction."""
    return (F.col("bp1_tid") == F.col("bp2_tid")) & (F.col("bp1_state") != F.col("bp2_state"))


def junction_id(prefix: str = "SV") -> Column:
    return F.concat_ws(":", F.lit(prefix), "kind", "locus", "n1", "n2", "cand", F.coalesce("asm", F.lit(0)), F.coalesce("seg", F.lit(0)))


def mate_ids(ident: Column) -> tuple[Column, Column]:
    return F.concat(ident, F.lit(":0")), F.concat(ident, F.lit(":1"))


def of_edge(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Observations with the edges (locus, n1, n2) whose two nodes their breakends touch, either way round."""
    own = lambda k: nodes.select(F.col("locus").alias(f"l{k}"), F.col("node").alias(f"m{k}"), F.col("tid").alias(f"t{k}"), F.col("begin").alias(f"b{k}"), F.col("end").alias(f"e{k}"))
    one = intervals.overlap_join(found, own(1), left_cols=("bp1_tid", "bp1_begin", "bp1_end"), right_cols=("t1", "b1", "e1")).drop("t1", "b1", "e1")
    spanning = one.where(is_spanning())
    two = intervals.overlap_join(spanning, own(2), left_cols=("bp2_tid", "bp2_begin", "bp2_end"), right_cols=("t2", "b2", "e2")).drop("t2", "b2", "e2", "l2")
    alone = one.where(~is_spanning()).withColumn("m2", F.col("m1"))
    rows = two.unionByName(alone).withColumn("n1", F.least("m1", "m2")).withColumn("n2", F.greatest("m1", "m2")).withColumn("locus", F.col("l1")).drop("m1", "m2", "l1")
    return rows.join(edges.select("locus", "n1", "n2"), ["locus", "n1", "n2"], "left_semi")


def regrouped(found: DataFrame, keys=("locus", "n1", "n2")) -> DataFrame:
    """One row for each fragment of an edge, its observations in an array; a fragment has few."""
    rest = [c for c in found.columns if c not in (*keys, "sample", "qname")]
    return found.groupBy(*keys, "sample", "qname").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("observations"))


_CANDIDATE = (
    "locus long, n1 long, n2 long, cand int, bp1_state int, bp1_tid int, bp1_begin long, bp1_end long, bp2_state int, bp2_tid int, bp2_begin long, bp2_end long, "
    "n_fragments long, n_pair long, n_split long, n_indel long, n_semi long, evidence array<struct<sample:int,bp:int,tid:int,pos:long>>"
)


def _touch(a: dict, b: dict, x: str, y: str) -> bool:
    if a[f"{x}_state"] != b[f"{y}_state"]:
        return False
    if a[f"{x}_state"] == 0:
        return True
    return a[f"{x}_tid"] == b[f"{y}_tid"] and a[f"{x}_begin"] < b[f"{y}_end"] and b[f"{y}_begin"] < a[f"{x}_end"]


def _grow(c: dict, o: dict, swap: bool) -> None:
    for x, y in (("bp1", "bp2" if swap else "bp1"), ("bp2", "bp1" if swap else "bp2")):
        if c[f"{x}_state"]:
            c[f"{x}_begin"], c[f"{x}_end"] = min(c[f"{x}_begin"], o[f"{y}_begin"]), max(c[f"{x}_end"], o[f"{y}_end"])


def _told(o: dict, straight: bool) -> dict:
    """The observation with the places of the reads that speak for its candidate's first and second breakend."""
    at = ((o["r1_tid"], o["r1_pos"]), (o["r2_tid"], o["r2_pos"]))
    return o | {"at": at if straight else at[::-1]}


def cluster_edge(rows: list[dict]) -> list[dict]:
    """Candidates of one edge: each observation joins the first candidate that it matches, either way round, or starts one.

    Afterwards candidates that came to touch are joined.
    """
    found: list[dict] = []
    for o in rows:
        for c in found:
            straight = _touch(c, o, "bp1", "bp1") and _touch(c, o, "bp2", "bp2")
            if straight or (_touch(c, o, "bp1", "bp2") and _touch(c, o, "bp2", "bp1")):
                _grow(c, o, not straight)
                c["members"].append(_told(o, straight))
                break
        else:
            found.append({k: o[k] for k in o if k.startswith("bp")} | {"members": [_told(o, True)]})
    i = 0
    while i < len(found):
        a, j, grown = found[i], i + 1, False
        while j < len(found):
            b = found[j]
            straight = _touch(a, b, "bp1", "bp1") and _touch(a, b, "bp2", "bp2")
            if straight or (_touch(a, b, "bp1", "bp2") and _touch(a, b, "bp2", "bp1")):
                _grow(a, b, not straight)
                a["members"] += [m if straight else m | {"at": m["at"][::-1]} for m in b["members"]]
                del found[j]
                grown = True
            else:
                j += 1
        # one that grew may touch others now, those before it too
        i = 0 if grown else i + 1
    return found


def clustered(found: DataFrame) -> DataFrame:
    """Candidates of each edge (locus, n1, n2) from its observations."""
    order = ["bp1_tid", "bp1_begin", "bp1_end", "bp2_tid", "bp2_begin", "bp2_end", "sample", "qname", "read_no", "ev_type"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        names = pdf[["sample", "qname"]].drop_duplicates()
        names = names.assign(h=[crc32(f"{a}/{b}".encode()) for a, b in zip(names["sample"], names["qname"])]).sort_values(["h", "sample", "qname"]).head(MAX_FRAGMENTS).drop(columns="h")
        pdf = pdf.merge(names, on=["sample", "qname"])
        out = []
        for k, c in enumerate(cluster_edge(pdf.to_dict("records"))):
            kinds = [m["ev_type"] for m in c["members"]]
            fragments = {(m["sample"], m["qname"]) for m in c["members"]}
            places = sorted({(m["sample"], m["qname"], bp): (m["sample"], bp, *m["at"][bp - 1]) for m in c["members"] for bp in (1, 2) if c[f"bp{bp}_state"]}.values())
            n = lambda *t: sum(x in t for x in kinds)  # noqa: E731, B023
            row = {x: c[x] for x in c if x.startswith("bp")}
            out.append({"locus": pdf["locus"].iloc[0], "n1": pdf["n1"].iloc[0], "n2": pdf["n2"].iloc[0], "cand": k, **row, "n_fragments": len(fragments), "n_pair": n("PAIR", "LOCAL_PAIR"), "n_split": n("SPLIT_ALIGN"), "n_indel": n("CIGAR"), "n_semi": n("SEMIALIGN", "SOFTCLIP"), "evidence": [dict(zip(("sample", "bp", "tid", "pos"), (int(x) for x in e))) for e in places]})
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in _CANDIDATE.split(", ")])

    return found.groupBy("locus", "n1", "n2").applyInPandas(run, _CANDIDATE)


CANDIDATE = ["locus", "n1", "n2", "cand"]


def read_places(reads: DataFrame) -> DataFrame:
    """sample, tid, block, pos0, n (reads that start there) and before (reads of the sample in blocks before it) of reads."""
    here = reads.groupBy("sample", "tid", F.expr(f"pos0 div {intervals.BLOCK}").alias("block"), "pos0").agg(F.count("*").alias("n"))
    blocks = here.groupBy("sample", "tid", "block").agg(F.sum("n").alias("_n"))
    along = Window.partitionBy("sample").orderBy("tid", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("sample", "tid", "block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("before"))
    return here.join(blocks, ["sample", "tid", "block"])


def indexed(candidates: DataFrame, reads: DataFrame) -> DataFrame:
    """Candidate keys, is_complex, sample, bp and index of each piece of evidence: how many reads of the sample start up to its place, over all contigs."""
    rows = candidates.select(*CANDIDATE, is_complex().alias("is_complex"), F.explode("evidence").alias("e")).select(*CANDIDATE, "is_complex", "e.*")
    rows = rows.withColumns({"block": F.expr(f"pos div {intervals.BLOCK}"), "kind": F.lit(1)}).withColumnRenamed("pos", "pos0")
    places = read_places(reads).withColumn("kind", F.lit(0))
    w = Window.partitionBy("sample", "tid", "block").orderBy("pos0", "kind")
    both = rows.unionByName(places, allowMissingColumns=True)
    up_to = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    before = F.max("before").over(Window.partitionBy("sample", "tid", "block"))
    return both.withColumn("index", (up_to + F.coalesce(before, F.lit(0))).cast("long")).where("kind = 1").select(*CANDIDATE, "is_complex", "sample", "bp", "index")


def signals(evidence: DataFrame, rates: DataFrame, window: int = 4) -> DataFrame:
    """p_signal of each candidate: the least binomial tail over samples and breakends (the first one only of complex candidates).

    evidence has the candidate's keys, is_complex, sample, bp and index (columns of indexed). In each breakend's sorted
    indexes the window + 1 that lie closest tell how many reads there are for window observations; fewer observations
    than that count at most as many as there are reads, and a single one says nothing. rates has sample, anomalous_rate
    and assembly_rate.
    """
    own = evidence.where("bp = 1 OR NOT is_complex").groupBy(*CANDIDATE, "is_complex", "sample", "bp").agg(F.sort_array(F.collect_list("index")).alias("_at"))
    n = F.size("_at")
    w = F.least(F.lit(window), n - 1)
    gaps = F.transform(F.slice("_at", 1, F.greatest(n - w, F.lit(0))), lambda x, i: F.get("_at", i + w) - x)
    own = own.where(n > 1).withColumn("_reads", F.array_min(gaps)).withColumn("_hits", F.least(w.cast("long"), F.col("_reads")))
    own = own.join(F.broadcast(rates.select("sample", "anomalous_rate", "assembly_rate")), "sample")  # a row for each sample
    rate = F.when(F.col("is_complex"), F.col("assembly_rate")).otherwise(F.col("anomalous_rate"))
    p = F.when(F.col("_hits") > 0, prob.binomial_tail("_hits", "_reads", rate)).otherwise(1.0)
    return own.withColumn("_p", p).groupBy(*CANDIDATE).agg(F.min("_p").alias("p_signal"))


def with_significance(candidates: DataFrame, rates: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds p_signal from the candidates' evidence among the reads of each sample; 1 without any."""
    found = signals(indexed(candidates, reads), rates)
    return candidates.join(found, CANDIDATE, "left").withColumn("p_signal", F.coalesce("p_signal", F.lit(1.0)))


def junction_filter() -> Column:
    """Why a candidate is dropped (SEMI_MAPPED, COMPLEX_LOW_COUNT, COMPLEX_LOW_SIGNAL) or only marked (SPANNING_LOW_SIGNAL); null if it is fine."""
    local_only = is_spanning() & (F.col("n_split") + F.col("n_indel") + F.col("n_semi") + F.col("n_pair") == 0)
    return (
        F.when(local_only, "SEMI_MAPPED")
        .when(is_complex() & (F.col("n_fragments") < 2), "COMPLEX_LOW_COUNT")
        .when(is_complex() & (F.col("p_signal") > COMPLEX_ALPHA), "COMPLEX_LOW_SIGNAL")
        .when(is_spanning() & (F.col("p_signal") > SPANNING_ALPHA), "SPANNING_LOW_SIGNAL")
    )


def filtered(candidates: DataFrame) -> DataFrame:
    out = candidates.withColumn("mark", junction_filter())
    return out.where("mark IS NULL OR mark = 'SPANNING_LOW_SIGNAL'")


def junction_pairs(candidates: DataFrame, near: int = 1000, small: int = 100_000) -> DataFrame:
    """Events: pairs of spanning candidates of an edge whose breakends lie close in opposite orientation, others alone.

    A candidate that would pair with more than one other clears the edge's pairs. Small innies do not pair.
    """
    c = lambda p, x: intervals.center(F.col(f"{p}_{x}_begin"), F.col(f"{p}_{x}_end"))
    usable = candidates.where(is_spanning() & ~((sv_type() == "INDEL") & (center_size() < small)))
    side = lambda p: usable.select("locus", "n1", "n2", *[F.col(x).alias(f"{p}_{x}") for x in ("cand", "bp1_state", "bp1_tid", "bp1_begin", "bp1_end", "bp2_state", "bp2_tid", "bp2_begin", "bp2_end")])
    close = lambda x, y: (F.col(f"a_{x}_tid") == F.col(f"b_{y}_tid")) & (F.col(f"a_{x}_state") != F.col(f"b_{y}_state")) & (F.abs(c("a", x) - c("b", y)) < near)
    hit = side("a").join(side("b"), ["locus", "n1", "n2"]).where("a_cand < b_cand").where((close("bp1", "bp1") & close("bp2", "bp2")) | (close("bp1", "bp2") & close("bp2", "bp1")))
    ends = hit.select("locus", "n1", "n2", F.explode(F.array("a_cand", "b_cand")).alias("cand"))
    crowded = ends.groupBy("locus", "n1", "n2", "cand").count().where("count > 1").select("locus", "n1", "n2").distinct()
    pairs = hit.join(crowded, ["locus", "n1", "n2"], "left_anti").select("locus", "n1", "n2", F.col("a_cand").alias("event"), F.explode(F.array("a_cand", "b_cand")).alias("cand"))
    return candidates.join(pairs, ["locus", "n1", "n2", "cand"], "left").withColumn("event", F.coalesce("event", "cand"))


def event_filter(candidates: DataFrame, least: int = 3) -> DataFrame:
    """Events with spanning evidence: some junction has at least `least` pairs or splits and one is unmarked; complex ones pass."""
    keys = ["locus", "n1", "n2", "event"]
    good = candidates.groupBy(*keys).agg(
        (F.bool_or(is_complex()) | (F.bool_or(F.col("n_pair") + F.col("n_split") + F.col("n_indel") >= least) & F.bool_or(F.col("mark").isNull()))).alias("_ok")
    )
    return candidates.join(good.where("_ok").select(*keys), keys, "left_semi")


def refined_filter(junctions: DataFrame, least: int = 3, min_size: int = 8) -> DataFrame:
    """Events after assembly: enough spanning support in each junction (at least two) and in one, complex ones precise, and none too small."""
    keys = ["locus", "n1", "n2", "event"]
    support = F.col("n_pair") + F.col("n_split")
    ok = junctions.groupBy(*keys).agg(
        (
            F.bool_and(F.col("imprecise").eqNullSafe(False) | (support >= min(2, least)))
            & F.bool_or(F.col("imprecise").eqNullSafe(False) | (support >= least))
            & F.bool_and(~is_complex() | ~F.col("imprecise"))
            & F.bool_and(~below_size(min_size, F.coalesce(F.length("insert_seq"), F.lit(0))))
        ).alias("_ok")
    )
    return junctions.join(ok.where("_ok").select(*keys), keys, "left_semi")
