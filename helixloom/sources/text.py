"""Text sources and sinks: SAM, BED, VCF, FASTA with its index, depth tables. All read through Spark's text reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq

_HEADER = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _tag(name: str) -> Column:
    return F.when(F.col("value").rlike(f"\t{name}:Z:"), F.regexp_extract("value", f"\t{name}:Z:([^\t]*)", 1))


def read_sam(spark: SparkSession, path: str, contigs: DataFrame, sample: int = 0) -> DataFrame:
    """Alignments of a SAM text file. contigs (tid, label, length) must hold every reference name."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    f = F.split("value", "\t")
    raw = rows.select("value", *[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(_HEADER)], F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("_tags"))
    named = lambda a, b: F.broadcast(contigs.select(F.col("label").alias(a), F.col("tid").alias(b)))
    raw = raw.withColumn("rnext", F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")))
    raw = raw.join(named("rname", "tid"), "rname", "left").join(named("rnext", "mate_tid"), "rnext", "left")
    tags = F.map_from_entries(F.transform("_tags", lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    quality = F.when(F.col("qual") == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33))
    return raw.select(
        "qname", F.col("flag").cast("int").alias("flag"), F.lit(sample).alias("sample"), "tid", (F.col("pos").cast("int") - 1).alias("pos0"), F.col("mapq").cast("int").alias("mapq"), "cigar",
        "mate_tid", (F.col("pnext").cast("int") - 1).alias("mate_pos0"), F.col("tlen").cast("int").alias("tlen"), "seq", quality.alias("qual"), _tag("SA").alias("sa"), _tag("MC").alias("mc"), tags.alias("tags"),
    )


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid, label and length of the @SQ lines, in file order (lines of a header are few)."""
    rows = [r.value for r in spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).collect()]
    found = [(re.search(r"\tSN:([^\t]+)", x)[1], int(re.search(r"\tLN:(\d+)", x)[1])) for x in rows]
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(found)], "tid int, label string, length int")


def sample_name(header: list[str], number: int = 1) -> str:
    """The first read group's sample, with spaces as underscores, or SAMPLE and a number."""
    for x in header:
        if x.startswith("@RG") and (m := re.search(r"\tSM:([^\t\n]+)", x)):
            return m[1].replace(" ", "_")
    return f"SAMPLE{number}"


def write_sam(reads: DataFrame, path: str, contigs: DataFrame) -> None:
    """Alignments as SAM lines (no header), in order of place."""
    name = lambda c: F.coalesce(F.col(c), F.lit("*"))
    a, b = contigs.select("tid", F.col("label").alias("_r")), contigs.select(F.col("tid").alias("mate_tid"), F.col("label").alias("_m"))
    df = reads.join(F.broadcast(a), "tid", "left").join(F.broadcast(b), "mate_tid", "left")
    quality = F.when(F.size("qual") > 0, F.array_join(F.transform("qual", lambda q: F.chr(q + 33)), "")).otherwise("*")
    tags = F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.lit(":Z:"), F.col("tags")[k])) if "tags" in reads.columns else F.array().cast("array<string>")
    if "zm" in reads.columns:
        tags = F.concat(tags, F.array(F.concat(F.lit("ZM:Z:"), "zm")))
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), name("_r"), (F.col("pos0") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", name("_m"), (F.col("mate_pos0") + 1).cast("string"), F.col("tlen").cast("string"), "seq", quality, F.when(F.size(tags) > 0, F.array_join(tags, "\t")))
    df.orderBy("tid", "pos0", "qname").select(line.alias("value")).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, begin and end of lines that hold a range; headers and empty or inverted ranges are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    out = rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("int").alias("begin"), F.get(f, F.lit(2)).try_cast("int").alias("end"))
    return out.where("begin < end")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF text file, as in operators.vcf."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    labels = F.when(at(6).isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(at(6), ";"))
    return rows.select(at(0).alias("chrom"), at(1).cast("int").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), labels.alias("filter"), at(7).alias("info"), at(8).alias("format"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"))


def vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a VCF header, in its order."""
    rows = [r.value for r in spark.read.text(path).where(F.startswith("value", F.lit("##contig="))).collect()]
    names = [(m[1], int(n[1]) if (n := re.search(r"length=(\d+)", x)) else 0) for x in rows if (m := re.match(r"^##contig=<ID=([^,>]*)[,>]", x))]
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(names)], "tid int, label string, length int")


def is_normalised(record: DataFrame) -> DataFrame:
    """Adds normalised: no allele shares its last base with ref, and none its first where both are longer than one."""
    ref, alt = F.col("ref"), F.col("alt")
    last = F.right(ref, F.lit(1)) == F.right(alt, F.lit(1))
    first = (F.left(ref, F.lit(1)) == F.left(alt, F.lit(1))) & (F.length(ref) > 1) & (F.length(alt) > 1)
    return record.withColumn("normalised", alt.rlike(r"[<>\[\]]") | ~(last | first))


def write_vcf(records: DataFrame, path: str, head: list[str]) -> None:
    """Ordered records under a header, as text parts in order; the header is the first part."""
    from ..operators import vcf

    spark = records.sparkSession
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(path)
    vcf.lines(records).withColumnRenamed("line", "value").write.mode("append").text(path)


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """tid, label, length, offset and line sizes of a .fai file, in file order (a row for each contig)."""
    raw = spark.read.csv(path, sep="\t", schema="label string, length long, start long, bases int, width int")
    rows = sorted((tuple(r) for r in raw.collect()), key=lambda r: r[2])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tid int, label string, length long, start long, bases int, width int")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """label and bases of each sequence, standardised."""
    rows = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    label = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(label.alias("label"), seq.standard(body).alias("bases"))


def chunked(fasta: DataFrame, contigs: DataFrame, size: int = 1 << 20, margin: int = 1000) -> DataFrame:
    """tid, chunk, offset and bases of overlapping pieces, so that a region needs one row."""
    n = F.expr(f"greatest(length(bases) - 1, 0) div {size}")
    df = fasta.join(F.broadcast(contigs.select("tid", "label")), "label").withColumn("chunk", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    start = F.greatest(F.lit(0), F.col("chunk") * size - margin)
    return df.select("tid", "chunk", start.alias("offset"), F.substring("bases", start + 1, F.lit(size + 2 * margin)).alias("bases"))


def region_bases(bases: Column, offset: Column, begin: Column, end: Column) -> Column:
    """Bases [begin, end) out of a piece; places outside it are N."""
    lead = F.greatest(F.lit(0), offset - begin)
    inside = F.substring(bases, F.greatest(begin - offset, F.lit(0)) + 1, F.greatest(end - begin - lead, F.lit(0)))
    return F.rpad(F.concat(F.repeat(F.lit("N"), lead), inside), end - begin, F.lit("N"))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """label and depth; lines without just two fields raise."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.trim("value") != "")
    ok = F.when(F.size(f) == 2, F.get(f, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("Unexpected depth line: "), F.col("value"))).cast("string"))
    return rows.select(ok.alias("label"), F.get(f, F.lit(1)).cast("double").alias("depth"))


def concatenated(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def merged_stats(*tables: DataFrame, key: str = "sample") -> DataFrame:
    """Tables of per-sample statistics as one; a key that occurs in two of them raises."""
    tagged = concatenated(*[t.withColumn("_from", F.lit(k)) for k, t in enumerate(tables)])
    twice = tagged.groupBy(key).agg(F.countDistinct("_from").alias("n")).where("n > 1")
    if clash := twice.limit(1).collect():
        raise ValueError(f"Statistics for {clash[0][0]!r} are given twice")
    return tagged.drop("_from")
