"""VCF records as a table: building them, ordering, de-duplication and post-processing filters.

The table has chrom, pos, id, ref, alt, qual (double, null for '.'), filter (array of labels, empty for PASS),
info (string), format (string, null without samples) and samples (array of strings).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq
from . import intervals
from .partitioning import spread


def info(key: str, source: Column | str = "info") -> Column:
    """The value of an INFO key; null if it is not there."""
    text = F.col(source) if isinstance(source, str) else source
    found = F.regexp_extract(text, f"(?:^|;){key}=([^;]*)", 1)
    return F.when(text.rlike(f"(?:^|;){key}="), found)


def has_flag(key: str) -> Column:
    return F.col("info").rlike(f"(?:^|;){key}(?:;|$)")


def joined_info(**tags) -> Column:
    """key=value fields in the order given; flags are True or false columns, nulls are left out."""
    parts = [F.when(v.cast("boolean"), F.lit(k)) if flag else F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, (v, flag) in tags.items()]
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))


def value(c: Column) -> tuple[Column, bool]:
    return c, False


def flag(c: Column) -> tuple[Column, bool]:
    return c, True


def joined_sample(*fields: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(f.cast("string"), F.lit(".")) for f in fields])


def end_pos() -> Column:
    return F.coalesce(info("END").cast("int"), F.col("pos") + F.length("ref") - 1)


def is_pass() -> Column:
    return F.size("filter") == 0


def contig_rank(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds rank: the contig's place in the header, for unknown contigs the number of contigs. contigs has label and tid."""
    known = contigs.select(F.col("label").alias("chrom"), F.col("tid").alias("_rank"))
    n = contigs.count()
    return df.join(F.broadcast(known), "chrom", "left").withColumn("rank", F.coalesce("_rank", F.lit(n))).drop("_rank")


ORDER = ("rank", "chrom", "pos", "end_pos", "ref", "alt", "id")


def ordered(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records in header order of contigs, then by place; a range-partitioned sort."""
    return contig_rank(df, contigs).withColumn("end_pos", end_pos()).orderBy(*ORDER).drop("rank", "end_pos")


def breakend_rows(events: DataFrame) -> DataFrame:
    """Two records for each breakend pair: bracket notation, MATEID, CIPOS, homology and inserted sequence.

    events has id, chrom1, pos1, end1, state1, ref1 and the same for 2 (0-based half-open), insert_seq, imprecise, and qual and filter.
    """
    ends = F.array(*[F.struct(F.lit(k - 1).alias("k"), *[F.col(f"{x}{a}").alias(f"{y}") for x, y in (("chrom", "chrom"), ("pos", "p"), ("end", "e"), ("state", "s"), ("ref", "r"))], *[F.col(f"{x}{b}").alias(f"m_{y}") for x, y in (("chrom", "chrom"), ("pos", "p"), ("end", "e"), ("state", "s"))]) for k, (a, b) in enumerate(((1, 2), (2, 1)), 1)])
    df = events.select("*", F.explode(ends).alias("b"))
    right = F.col("b.s") == 1
    place = lambda p, e: F.when(F.col("imprecise"), intervals.center(F.col(p), F.col(e))).otherwise(F.col(p)) + 1
    mate = F.concat(F.col("b.m_chrom"), F.lit(":"), place("b.m_p", "b.m_e").cast("string"))
    bracket = F.when(F.col("b.m_s") == 1, F.concat(F.lit("]"), mate, F.lit("]"))).otherwise(F.concat(F.lit("["), mate, F.lit("[")))
    same = (F.col("state1") == F.col("state2")) & (F.col("b.k") == 1)
    inserted = F.coalesce(F.when(same, seq.reverse_complement(F.col("insert_seq"))).otherwise(F.col("insert_seq")), F.lit(""))
    alt = F.when(right, F.concat(F.col("b.r"), inserted, bracket)).otherwise(F.concat(bracket, inserted, F.col("b.r")))
    size = F.col("b.e") - F.col("b.p")
    center = intervals.center(F.col("b.p"), F.col("b.e"))
    ci = F.when(F.col("imprecise"), F.concat_ws(",", (F.col("b.p") - center).cast("string"), (F.col("b.e") - 1 - center).cast("string"))).when(size > 1, F.concat(F.lit("0,"), (size - 1).cast("string")))
    text = joined_info(SVTYPE=value(F.lit("BND")), MATEID=value(F.concat("id", F.lit(":"), (1 - F.col("b.k")).cast("string"))), IMPRECISE=flag(F.col("imprecise")), CIPOS=value(ci), HOMLEN=value(F.when(~F.col("imprecise") & (size > 1), size - 1)), SVINSLEN=value(F.when(F.length("insert_seq") > 0, F.length("insert_seq"))), SVINSSEQ=value(F.when(F.length("insert_seq") > 0, F.col("insert_seq"))))
    return df.select(F.col("b.chrom").alias("chrom"), place("b.p", "b.e").cast("int").alias("pos"), F.concat("id", F.lit(":"), F.col("b.k").cast("string")).alias("id"), F.col("b.r").alias("ref"), alt.alias("alt"), "qual", "filter", text.alias("info"))


def indel_rows(events: DataFrame, small: int = 1000) -> DataFrame:
    """Records of deletions, insertions and tandem duplications: sequences for small precise ones, symbols otherwise.

    events has id, kind (DELETE, INSERT, TANDUP), chrom, pos (0-based place before the event), end, ref (bases from
    pos on), insert_seq, imprecise, homology, qual and filter.
    """
    size = F.col("end") - F.col("pos") - 1
    inserted = F.length(F.coalesce("insert_seq", F.lit("")))
    is_small = (F.greatest(size, inserted) <= small) & ~F.col("imprecise") & (F.col("kind") != "TANDUP")
    symbol = F.when(F.col("kind") == "DELETE", "<DEL>").when(F.col("kind") == "INSERT", "<INS>").otherwise("<DUP:TANDEM>")
    base = F.substring("ref", 1, 1)
    length = F.when(F.col("kind") == "DELETE", -size).when(F.col("kind") == "INSERT", F.when(inserted > 0, inserted)).otherwise(size)
    text = joined_info(
        END=value(F.when(F.col("kind") == "INSERT", F.col("pos") + 1).otherwise(F.col("end"))),
        SVTYPE=value(F.when(F.col("kind") == "DELETE", "DEL").when(F.col("kind") == "INSERT", "INS").otherwise("DUP")),
        SVLEN=value(length),
        CIGAR=value(F.when(is_small, F.concat(F.lit("1M"), F.when(inserted > 0, F.concat(inserted.cast("string"), F.lit("I"))).otherwise(""), F.when(size > 0, F.concat(size.cast("string"), F.lit("D"))).otherwise("")))),
        IMPRECISE=flag(F.col("imprecise")),
        HOMLEN=value(F.when(F.length("homology") > 0, F.length("homology"))),
        HOMSEQ=value(F.when(F.length("homology") > 0, F.col("homology"))),
    )
    return events.select(
        "chrom", (F.col("pos") + 1).cast("int").alias("pos"), "id", F.when(is_small, F.col("ref")).otherwise(base).alias("ref"),
        F.when(is_small, F.concat(base, F.coalesce("insert_seq", F.lit("")))).otherwise(symbol).alias("alt"), "qual", "filter", text.alias("info"),
    )


#: FORMAT and the sample fields of each kind of output.
MODELS = {
    "candidate": (),
    "diploid": ("GT", "FT", "GQ", "PL", "PR", "SR"),
    "somatic": ("PR", "SR"),
    "tumor": ("PR", "SR"),
    "rna": ("PR", "SR"),
}


def with_samples(records: DataFrame, support: DataFrame, model: str) -> DataFrame:
    """Adds format and samples from support (id, sample, and the model's fields: gt, ft, gq, pl, ref_spanning, alt_spanning, ref_split, alt_split)."""
    fields = MODELS[model]
    pair = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    made = {
        "GT": lambda: F.when(F.col("gt") == "HET", "0/1").when(F.col("gt") == "HOM", "1/1").when(F.col("gt") == "REF", "0/0"),
        "FT": lambda: F.when(F.size("ft") == 0, "PASS").otherwise(F.array_join("ft", ";")),
        "GQ": lambda: F.col("gq"),
        "PL": lambda: F.array_join(F.transform("pl", lambda x: x.cast("string")), ","),
        "PR": lambda: pair("ref_spanning", "alt_spanning"),
        "SR": lambda: pair("ref_split", "alt_split"),
    }
    if not fields:
        return records.withColumn("format", F.lit(None).cast("string")).withColumn("samples", F.array().cast("array<string>"))
    rows = support.select("id", "sample", joined_sample(*[made[f]() for f in fields]).alias("_s")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "_s"))), lambda x: x["_s"]).alias("samples"))
    return records.join(rows, "id", "left").withColumn("format", F.lit(":".join(fields)))


def lines(records: DataFrame) -> DataFrame:
    """Records as text lines."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    labels = F.when(is_pass(), "PASS").otherwise(F.array_join("filter", ";"))
    fixed = [F.col("chrom"), F.col("pos").cast("string"), text("id"), F.col("ref"), F.col("alt"), F.coalesce(F.format_string("%.0f", "qual"), F.lit(".")), labels, text("info")]
    out = F.concat_ws("\t", *fixed)
    if "samples" in records.columns:
        out = F.when(F.col("format").isNull(), out).otherwise(F.concat_ws("\t", out, "format", F.array_join("samples", "\t")))
    return records.select(out.alias("line"))


def header(contigs: list[tuple[str, int]], samples: list[str], command: str | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.1"] + [f"##contig=<ID={label},length={length}>" for label, length in contigs]
    if command:
        out.append(f"##cmdline={command}")
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]


def with_command(head: list[str], command: str) -> list[str]:
    """A header with its ##cmdline line replaced, or added before the column line."""
    out = [x for x in head if not x.startswith("##cmdline=")]
    return [*out[:-1], f"##cmdline={command}", out[-1]]


def best_first() -> list[Column]:
    """Order of equal records: passed ones, then higher quality, then assembled ones."""
    return [(~is_pass()).cast("int"), F.coalesce(F.col("qual"), F.lit(0.0)).desc(), F.substring("alt", 1, 1).eqNullSafe("<").cast("int"), F.col("id")]


def best_of_equal(records: DataFrame) -> DataFrame:
    """The best of records with equal place, alleles and end; mates of dropped breakends go as well. Free of record order."""
    w = Window.partitionBy("chrom", "pos", "ref", "alt", "_end", "_inv").orderBy(*best_first())
    inv = F.when(has_flag("INV3"), "INV3").when(has_flag("INV5"), "INV5").otherwise("")
    ranked = records.withColumn("_end", end_pos()).withColumn("_inv", inv).withColumn("_nth", F.row_number().over(w))
    gone = ranked.where("_nth > 1").select(info("MATEID").alias("id")).where("id IS NOT NULL").distinct()
    return ranked.where("_nth = 1").drop("_end", "_inv", "_nth").join(gone, "id", "left_anti").select(*records.columns)


def _same(a: dict, b: dict) -> bool:
    if any(a[k] != b[k] for k in ("chrom", "pos", "ref", "end_pos", "inv")):
        return False
    if a["alt"] == b["alt"]:
        return True
    long = lambda alt: alt[0] != "<" and len(alt) >= 80
    return (a["alt"] == "<INS>" and long(b["alt"])) or (b["alt"] == "<INS>" and long(a["alt"]))


def _best(group: list[dict]) -> dict:
    best, quality, passed, assembled = group[0], 0.0, False, False
    for r in group:
        q = r["qual"] if r["qual"] is not None and r["qual"] == r["qual"] else 0.0
        own = r["alt"][0] != "<"
        if (r["passed"] and not passed) or (r["passed"] == passed and q > quality) or (own and not assembled):
            best, quality, passed, assembled = r, q, r["passed"], own
    return best


def deduplicated(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records in order, with runs of equal neighbours resolved to the best by the same steps as a sorted scan.

    Runs are found contig by contig, as equal records share a contig; a later assembled record wins over an earlier
    symbolic one whatever their quality. Mates of dropped breakends go, on whatever contig they are.
    """
    ranked = contig_rank(records, contigs).withColumns({"end_pos": end_pos(), "passed": is_pass(), "mate": info("MATEID"), "inv": F.when(has_flag("INV3"), "INV3").when(has_flag("INV5"), "INV5").otherwise("")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["pos", "end_pos", "ref", "alt", "id"], kind="stable").to_dict("records")
        out, group, removed = [], [], set()

        def close() -> None:
            if group:
                keep = _best(group)
                out.append((keep["id"], None))
                out.extend((None, r["mate"]) for r in group if r is not keep and r["mate"])
                removed.update(r["mate"] for r in group if r is not keep and r["mate"])

        last = None
        for r in rows:
            if r["id"] in removed:
                continue
            if last is None or not _same(r, last):
                close()
                group = []
            group.append(r)
            last = r
        close()
        return pd.DataFrame(out, columns=["kept", "mate_gone"])

    cols = ["chrom", "pos", "end_pos", "ref", "alt", "id", "qual", "passed", "mate", "inv"]
    found = ranked.select(*cols).groupBy("chrom").applyInPandas(run, "kept string, mate_gone string")
    from .graph import checkpointed

    found = checkpointed(found, "dedup")
    gone = found.where("mate_gone IS NOT NULL").select(F.col("mate_gone").alias("id")).distinct()
    kept = found.where("kept IS NOT NULL").select(F.col("kept").alias("id"))
    return ordered(records.join(kept, "id", "left_semi").join(gone, "id", "left_anti"), contigs)


def mates(records: DataFrame) -> DataFrame:
    """Breakend records with the columns of their mates (m_chrom, m_pos, m_alt)."""
    other = records.select(F.col("id").alias("mate"), F.col("chrom").alias("m_chrom"), F.col("pos").alias("m_pos"), F.col("alt").alias("m_alt"))
    return records.where(info("SVTYPE") == "BND").withColumn("mate", info("MATEID")).join(spread(other, "mate"), "mate", "left").drop("mate")


def allele_count(sample: Column, fmt: Column) -> Column:
    """Alternative alleles of a sample's GT; 0 without one."""
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int")
    gt = F.get(F.split(sample, ":"), at - 1)
    return F.when(at > 0, F.size(F.filter(F.split(gt, "[/|]"), lambda a: ~a.isin("0", ".")))).otherwise(0)


def ploidy_filtered(records: DataFrame) -> DataFrame:
    """Passed deletions and duplications that are stacked beyond two alleles in a sample get the label Ploidy.

    Records of a contig are scanned in order; each first record gathers those that begin before its end and are
    between half and twice its length, and all of them are filtered or kept together.
    """
    target = is_pass() & info("SVTYPE").isin("DEL", "DUP")
    counts = F.transform("samples", lambda s: allele_count(s, F.col("format")))
    rows = records.where(target).select("chrom", "id", "pos", end_pos().alias("end"), F.abs(info("SVLEN").cast("int")).alias("len"), counts.alias("counts"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = pdf.sort_values(["pos", "end", "id"], kind="stable").to_dict("records")
        bad = []
        while todo:
            first = todo[0]
            size = -1 if first["len"] != first["len"] or first["len"] is None else first["len"]
            total, stack = list(first["counts"]), [0]
            for k in range(1, len(todo)):
                r = todo[k]
                if r["pos"] >= first["end"]:
                    break
                own = -1 if r["len"] != r["len"] or r["len"] is None else r["len"]
                if 0.5 * size < own < 2 * size:
                    total = [a + b for a, b in zip(total, r["counts"])]
                    stack.append(k)
            if any(t > 2 for t in total):
                bad += [(todo[k]["id"],) for k in stack]
            gone = set(stack)
            todo = [r for k, r in enumerate(todo) if k not in gone]
        return pd.DataFrame(bad, columns=["id"])

    bad = rows.groupBy("chrom").applyInPandas(run, "id string").withColumn("_bad", F.lit(True))
    labelled = F.when(F.col("_bad"), F.array_append("filter", F.lit("Ploidy"))).otherwise(F.col("filter"))
    return records.join(bad, "id", "left").withColumn("filter", labelled).drop("_bad").select(*records.columns)


def stacked_pairs(df: DataFrame, keys, begin: str, end: str, size: Column) -> DataFrame:
    """Pairs of overlapping records of a key whose sizes differ by less than a factor of two."""
    rows = df.withColumn("_size", size)
    other = rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
    hit = intervals.overlap_join(rows, other, left_cols=(keys, begin, end), right_cols=(f"o_{keys}", f"o_{begin}", f"o_{end}"))
    return hit.where((F.col("o__size") < 2 * F.col("_size")) & (F.col("o__size") > 0.5 * F.col("_size")))


def inversions(records: DataFrame) -> DataFrame:
    """Breakend pairs on one contig that face the same way as single <INV> records, INV3 or INV5; the rest as it is."""
    paired = mates(records)
    parts = F.nullif(F.regexp_extract("alt", r"[\[\]](.+):([0-9]+)[\[\]]", 2), F.lit("")).cast("int")
    left_open = F.col("alt").rlike(r"^\[.*\[[ACGTN]+$")
    right_open = F.col("alt").rlike(r"^[ACGTN]+\].*\]$")
    rows = paired.withColumn("_mate_pos", parts).where((F.col("chrom") == F.col("m_chrom")) & (left_open | right_open)).withColumn("_inv", F.when(left_open, "INV5").otherwise("INV3"))
    first = rows.where((F.col("pos") < F.col("_mate_pos")) | ((F.col("pos") == F.col("_mate_pos")) & F.col("id").endswith(":0")))
    shift = F.when(F.col("_inv") == "INV5", 1).otherwise(0)
    end = F.col("_mate_pos") - shift
    start = F.col("pos") - shift
    rest = F.regexp_replace(F.col("info"), r"(?:^|;)(?:SVTYPE|MATEID|BND_DEPTH|MATE_BND_DEPTH|END|SVLEN)=[^;]*", "")
    text = F.concat(F.lit("END="), end.cast("string"), F.lit(";SVTYPE=INV;SVLEN="), (end - start).cast("string"), F.lit(";"), F.col("_inv"), F.when(F.ltrim(rest, F.lit(";")) != "", F.concat(F.lit(";"), F.ltrim(rest, F.lit(";")))).otherwise(""))
    made = first.withColumns({"info": text, "alt": F.lit("<INV>"), "pos": start.cast("int"), "id": F.regexp_replace("id", ":[01]$", "")}).select(*records.columns)
    gone = rows.select(F.explode(F.array("id", info("MATEID"))).alias("id"))
    return spread(records, "id").join(gone, "id", "left_anti").select(*records.columns).unionByName(made)


def de_novo(records: DataFrame, proband: int, mother: int, father: int) -> DataFrame:
    """Adds dq: 60 if the proband's genotype cannot be one allele from each parent, else 0; null without genotypes."""
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    alleles = lambda k: F.split(F.get(F.split(F.get("samples", F.lit(k)), ":"), at - 1), "[/|]")
    p, m, f = alleles(proband), alleles(mother), alleles(father)
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    fits = (F.array_contains(m, a) & F.array_contains(f, b)) | (F.array_contains(m, b) & F.array_contains(f, a))
    return records.withColumn("dq", F.when(at > 0, F.when(fits, 0).otherwise(60)))


def genotype_table(records: DataFrame, members) -> DataFrame:
    """How many records have each combination of genotypes of the members (places in samples)."""
    at = F.array_position(F.split("format", ":"), "GT").cast("int")
    gts = [F.get(F.split(F.get("samples", F.lit(k)), ":"), at - 1) for k in members]
    return records.groupBy(F.concat_ws("-", *gts).alias("genotypes")).agg(F.count("*").alias("n"))


def small_indels(records: DataFrame, most: int = 8) -> DataFrame:
    """Records with plain alleles of at most `most` bases more than one."""
    return records.where(~F.col("alt").rlike(r"[<>\[\]:]") & (F.length("ref") <= most + 1) & (F.length("alt") <= most + 1))


def sample_filter_refreshed(records: DataFrame, label: str = "SampleFT") -> DataFrame:
    """The label on records without a sample that passes, and on no others."""
    at = F.array_position(F.split("format", ":"), "FT").cast("int")
    passed = F.exists("samples", lambda s: F.get(F.split(s, ":"), at - 1) == "PASS") & (at > 0)
    clean = F.array_remove("filter", label)
    return records.withColumn("filter", F.when(passed, clean).otherwise(F.array_sort(F.array_append(clean, F.lit(label)))))


def large_enough(records: DataFrame, least: int) -> DataFrame:
    size = F.abs(F.coalesce(info("SVLEN").cast("int"), end_pos() - F.col("pos")))
    return records.where((info("SVTYPE") == "BND") | (size >= least))


def within_contig(records: DataFrame, most: int) -> DataFrame:
    """Records that span at most `most` bases of one contig; pairs on two contigs stay."""
    other = F.regexp_extract("alt", r"[\[\]](.+):([0-9]+)[\[\]]", 1)
    mate = F.nullif(F.regexp_extract("alt", r"[\[\]](.+):([0-9]+)[\[\]]", 2), F.lit("")).cast("long")
    span = F.when(other != "", F.abs(mate - F.col("pos"))).otherwise(end_pos() - F.col("pos"))
    return records.where(((other != "") & (other != F.col("chrom"))) | (span <= most))


def without_overlaps(records: DataFrame, pad: int = 350) -> DataFrame:
    """Of passed records whose padded ranges overlap in a run, the largest go until none overlap."""
    rows = records.where(is_pass()).select("chrom", "id", (F.col("pos") - pad).alias("b"), (end_pos() + pad).alias("e"))
    marked = intervals.islands(rows, ("chrom",), "b", "e")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["b", "e", "id"]].itertuples(index=False, name=None))
        gone = []
        while True:
            worst, end = None, None
            for b, e, i in rows:
                if end is not None and b < end[0]:
                    pair = max((end[1], (e - b, i)), key=lambda x: x)
                    worst = pair if worst is None else max(worst, pair)
                if end is None or e > end[0]:
                    end = (e, (e - b, i))
            if worst is None:
                return pd.DataFrame({"id": pd.Series(gone, dtype=object)})
            gone.append(worst[1])
            rows = [r for r in rows if r[2] != worst[1]]

    gone = marked.groupBy("chrom", "island").applyInPandas(prune, "id string")
    return records.join(gone, "id", "left_anti")


def merged_inversions(records: DataFrame, near: int = 250) -> DataFrame:
    """Inversions whose ends lie near each other as one; the first by place stays.

    Both ends are cut into squares of near + 1 places. All records of a square are near each other, so only its first
    can stay. It is held against the distinct places in the five squares that lie before and beside its own, so each
    place meets at most a few first ones, however many records are stacked.
    """
    is_inv = F.coalesce((info("SVTYPE") == "INV") & F.col("chrom").isNotNull() & F.col("pos").isNotNull() & end_pos().isNotNull(), F.lit(False))
    place = ["chrom", "_pos", "_end", "_none"]
    inv = records.where(is_inv).withColumns({"_pos": F.col("pos").cast("long"), "_end": end_pos().cast("long"), "_none": F.col("id").isNull()})
    square = lambda c: F.expr(f"CAST(floor({c} / {near + 1}) AS BIGINT)")
    points = inv.groupBy(*place).agg(F.min("id").alias("_id")).withColumns({"_row": square("_end"), "_column": square("_pos")})
    w = Window.partitionBy("chrom", "_row", "_column")
    ranked = points.withColumn("_first", F.min("_pos").over(w)).withColumn("_least", F.min(F.when(F.col("_pos") == F.col("_first"), F.col("_id"))).over(w))
    # a record without an id neither goes before others of its place nor after them
    first = ranked.where((F.col("_pos") == F.col("_first")) & F.coalesce(F.col("_id") <= F.col("_least"), F.lit(True)))
    about = F.array(*[F.struct((F.col("_row") + r).alias("r"), (F.col("_column") + c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0) if (r, c) != (0, 0)])
    asked = first.select(*place, "_id", F.explode(about).alias("_s")).select(*place, "_id", F.col("_s.r").alias("_row"), F.col("_s.c").alias("_column"))
    other = points.select(F.col("chrom").alias("o_chrom"), F.col("_pos").alias("o_pos"), F.col("_end").alias("o_end"), F.col("_id").alias("o_id"), F.col("_row").alias("o_row"), F.col("_column").alias("o_column"))
    before = (F.col("o_pos") < F.col("_pos")) | ((F.col("o_pos") == F.col("_pos")) & (F.col("o_id") < F.col("_id")))
    met = (F.col("chrom") == F.col("o_chrom")) & (F.col("_row") == F.col("o_row")) & (F.col("_column") == F.col("o_column"))
    later = asked.join(other, met & (F.col("_pos") - F.col("o_pos") <= near) & (F.abs(F.col("_end") - F.col("o_end")) <= near) & before, "left_semi").select(*place).distinct()
    stay = first.select(*place, "_id").join(later, place, "left_anti")
    kept = inv.join(stay.withColumnsRenamed({c: f"s{c}" for c in (*place, "_id")}), F.expr("chrom = schrom AND _pos = s_pos AND _end = s_end AND _none = s_none AND id <=> s_id"), "left_semi")
    return records.where(~is_inv).unionByName(kept.select(*records.columns))


def refiltered(records: DataFrame, least: int) -> DataFrame:
    """Somatic records with the score label set anew by a least SOMATICSCORE."""
    low = info("SOMATICSCORE").cast("int") < least
    clean = F.array_remove("filter", "MinSomaticScore")
    return records.withColumn("filter", F.when(low, F.array_sort(F.array_append(clean, F.lit("MinSomaticScore")))).otherwise(clean))


def with_pair_support(records: DataFrame) -> DataFrame:
    """Records with at least one alternative pair in some sample."""
    at = F.array_position(F.split("format", ":"), "PR").cast("int")
    alt = lambda s: F.get(F.split(F.get(F.split(s, ":"), at - 1), ","), F.lit(1)).cast("int")
    return records.where((at > 0) & F.exists("samples", lambda s: F.coalesce(alt(s) > 0, F.lit(False))))


def differences(a: DataFrame, b: DataFrame, columns=("chrom", "pos", "ref", "alt", "filter")) -> DataFrame:
    """Records of one table only, ids and scores left aside: side (left or right) and the columns."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def timing(log: DataFrame) -> DataFrame:
    """Summed seconds and count of each class of task (task, seconds); the class is the name up to its first number."""
    return log.groupBy(F.regexp_extract("task", r"^([^0-9]*?)[_-]?(?:[0-9].*)?$", 1).alias("kind")).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def supporting_reads(reads: DataFrame, support: DataFrame) -> DataFrame:
    """Reads with a ZM tag: the ids that each supports, with the kinds of support, from (sample, qname, read_no, tid, pos0, sv, kind)."""
    keys = ["sample", "qname", "read_no", "tid", "pos0"]
    # one aggregation: the kinds of each id are put together within a read's few rows
    found = spread(support.where("sv IS NOT NULL").select(*keys, "sv", "kind"), *keys).groupBy(*keys).agg(F.collect_set(F.struct("sv", "kind")).alias("_s"))
    kinds = lambda sv: F.array_join(F.array_sort(F.transform(F.filter("_s", lambda x: (x["sv"] == sv) & x["kind"].isNotNull()), lambda x: x["kind"])), "|")
    tag = found.select(*keys, F.array_join(F.array_sort(F.transform(F.array_distinct(F.transform("_s", lambda x: x["sv"])), lambda sv: F.concat(sv, F.lit("|"), kinds(sv)))), ",").alias("zm"))
    return reads.join(tag, keys)


#: Most ids that are sent to all tasks, counted first.
MOST_IDS = 100_000


def reads_of(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose ZM tag names one of the ids (id)."""
    named = reads.select("*", F.explode(F.transform(F.split("zm", ","), lambda x: F.substring_index(x, "|", 1))).alias("_id"))
    chosen = ids.select(F.col("id").alias("_id")).distinct()
    # few ids have many reads each: by a shuffle all reads of an id would be one task's
    hit = named.join(F.broadcast(chosen) if chosen.count() <= MOST_IDS else chosen, "_id", "left_semi").drop("_id")
    return hit.distinct()
