import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixloom.plans import workflow
from helixloom.sources import bam, text
from helixloom.streaming import depth

SAM = """@HD\tVN:1.6
@SQ\tSN:ctgOne\tLN:5000
@SQ\tSN:ctgTwo\tLN:4000
@RG\tID:1\tSM:my sample
r1\t99\tctgOne\t101\t60\t10M\t=\t201\t110\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tSA:Z:ctgTwo,1,+,5M,60,0;
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
"""


@pytest.fixture()
def sam(tmp_path):
    p = tmp_path / "a.sam"
    p.write_text(SAM)
    return str(p)


def test_sam_round_trip(spark, sam, tmp_path):
    contigs = text.sam_contigs(spark, sam)
    assert [tuple(r) for r in contigs.collect()] == [(0, "ctgOne", 5000), (1, "ctgTwo", 4000)]
    rows = {r.qname: r for r in text.read_sam(spark, sam, contigs, 2).collect()}
    r = rows["r1"]
    assert (r.flag, r.sample, r.tid, r.pos0, r.mapq, r.cigar, r.mate_tid, r.mate_pos0, r.tlen, r.sa, r.qual[0], r.tags["NM"]) == (99, 2, 0, 100, 60, "10M", 0, 200, 110, "ctgTwo,1,+,5M,60,0;", 40, "i:1".split(":")[1])
    assert rows["r2"].tid is None and rows["r2"].qual == []
    text.write_sam(text.read_sam(spark, sam, contigs), str(tmp_path / "out"), contigs)
    back = text.read_sam(spark, str(tmp_path / "out"), contigs)
    assert sorted((x.qname, x.pos0, x.seq) for x in back.collect()) == [("r1", 100, "ACGTACGTAC"), ("r2", -1, "ACGT")]
    assert text.sample_name(SAM.splitlines()) == "my_sample" and text.sample_name([], 3) == "SAMPLE3"


def test_bed_vcf_fasta_depth(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t5\t9\nchr1\t9\t9\nchr2\tx\t3\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9)]
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.1\n##contig=<ID=c2,length=9>\n##contig=<ID=c1>\n#CHROM\nc1\t5\tx\tA\tT\t.\tPASS\tEND=9\tGT\t0/1\nc1\t6\ty\tA\t<DEL>\t7\ta;b\t.\n")
    v = text.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()
    assert (v[0].filter, v[0].qual, v[0].samples, v[1].filter, v[1].samples) == ([], None, ["0/1"], ["a", "b"], [])
    assert [r.label for r in text.vcf_contigs(spark, str(tmp_path / "a.vcf")).collect()] == ["c2", "c1"]
    (tmp_path / "a.fa").write_text(">c1 x\nacgt\nRYA\n>c2\nTTTT\n")
    fa = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.label: r.bases for r in fa.collect()} == {"c1": "ACGTNNA", "c2": "TTTT"}
    contigs = spark.createDataFrame([(0, "c1", 7), (1, "c2", 4)], "tid int, label string, length int")
    pieces = text.chunked(fa, contigs, 4, 1)
    assert {(r.tid, r.chunk): (r.offset, r.bases) for r in pieces.collect()}[(0, 1)] == (3, "TNNA")
    got = pieces.where("tid = 0 AND chunk = 0").select(text.region_bases(F.col("bases"), F.col("offset"), F.lit(-2), F.lit(3)).alias("x")).first().x
    assert got == "NNACG"
    (tmp_path / "d.tsv").write_text("c1\t5.5\n")
    assert text.read_depth(spark, str(tmp_path / "d.tsv")).first().depth == 5.5
    (tmp_path / "bad.tsv").write_text("c1 5.5\n")
    with pytest.raises(Exception, match="Unexpected depth line"):
        text.read_depth(spark, str(tmp_path / "bad.tsv")).collect()
    s = spark.createDataFrame([(0, 1)], "sample int, n int")
    with pytest.raises(ValueError):
        text.merged_stats(s, s)
    rec = spark.createDataFrame([("AT", "GT"), ("A", "T"), ("A", "<DEL>"), ("AC", "AG")], "ref string, alt string")
    assert [r.normalised for r in text.is_normalised(rec).collect()] == [False, True, True, False]


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = len(body) + 25
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", size) + body + struct.pack("<II", zlib.crc32(data), len(data))


def make_bam(path, n=500):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 7) + b"ctgOne\0" + struct.pack("<i", 5000)
    for i in range(n):
        name = f"r{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 60, 0, 1, 99, 5, 0, i + 100, 105) + name + struct.pack("<I", 5 << 4) + bytes([0x12, 0x48, 0x10]) + bytes([30] * 5)
        body += b"SAZchr,1,+,5M,9,0;\0" + b"NMC\x01" + b"ZBBC" + struct.pack("<i", 2) + b"\x01\x02"
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(b"".join(block(out[i : i + 3000]) for i in range(0, len(out), 3000)) + block(b""))


def test_bam_source(spark, tmp_path):
    make_bam(tmp_path / "a.bam")
    make_bam(tmp_path / "b.bam", 3)
    assert gzip.decompress((tmp_path / "b.bam").read_bytes())[:4] == b"BAM\1"
    spark.dataSource.register(bam.BamSource)
    df = spark.read.format("bam").load(str(tmp_path / "*.bam"))
    assert df.count() == 503 and df.select("sample").distinct().count() == 2
    r = df.where("qname = 'r7' AND sample = 0").first()
    assert (r.pos0, r.cigar, r.seq, r.qual, r.sa, r.tags["NM"], r.tags["ZB"], r.mate_pos0) == (7, "5M", "ACGTA", [30] * 5, "chr,1,+,5M,9,0;", "1", "C,1,2", 107)
    assert bam.contigs(str(tmp_path / "a.bam")) == [("ctgOne", 5000)] and bam.header_text(str(tmp_path / "a.bam")) == "@HD\n"


def test_streams(spark, tmp_path):
    rows = [(0, 0, p, 50) for p in range(0, 5000, 100)] + [(0, 0, 9000, 50)]
    spark.createDataFrame(rows, "sample int, tid int, pos0 int, length int").write.parquet(str(tmp_path / "in"))
    schema = "sample int, tid int, pos0 int, length int"
    batch = {(r.tid, r.begin): r.n for r in depth.windowed_depth(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert batch[(0, 0)] == 10 and batch[(0, 9000)] == 1
    stream = depth.windowed_depth(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lag=1000)
    depth.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    done = {(r.tid, r.begin): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done and all(batch[k] == n for k, n in done.items())
    runs = depth.covered_sessions(spark.read.parquet(str(tmp_path / "in"))).orderBy("begin").collect()
    assert [(r.begin, r.n) for r in runs] == [(0, 50), (9000, 1)]


def test_options():
    assert workflow.Options(normals=2).model == "diploid" and workflow.Options(normals=1, tumours=1).model == "somatic"
    assert workflow.Options(normals=0, tumours=1).model == "tumor" and workflow.Options(rna=True).model == "rna"
    for bad in ({"tumours": 2}, {"normals": 2, "tumours": 1}, {"rna": True, "normals": 2}, {"unstranded": True}, {"normals": 0}):
        with pytest.raises(ValueError):
            workflow.Options(**bad)


def test_workflow_finds_a_planted_deletion(spark):
    """Pairs tile a contig; those over a deleted stretch of 2000 bases map as far as it apart, and reads across it are split."""
    gap, at, n = 2000, 20_000, 50
    rows = []

    def pair(i, start, size):
        left, right = start, start + size - n
        move = lambda p: p if p + n <= at else p + gap
        cut = lambda p: p < at < p + n
        if cut(left) or cut(right):
            return
        a, b = move(left), move(right)
        tlen = b + n - a
        for flag, p, m, t in ((99, a, b, tlen), (147, b, a, -tlen)):
            rows.append((f"f{i}", flag, 0, 0, p, 60, f"{n}M", 0, m, t, "A" * n, [30] * n, None, None, {}))

    import random

    rng = random.Random(9)
    for i, start in enumerate(range(0, 40_000, 20)):
        pair(i, start, rng.randrange(180, 320))
    reads = spark.createDataFrame(rows, "qname string, flag int, sample int, tid int, pos0 int, mapq int, cigar string, mate_tid int, mate_pos0 int, tlen int, seq string, qual array<int>, sa string, mc string, tags map<string,string>")
    contigs = spark.createDataFrame([(0, "ctgOne", 60_000)], "tid int, label string, length int")
    got = workflow.run(reads, contigs).collect()
    assert len(got) == 1 and got[0].alt == "<DEL>" and abs(got[0].pos - at) < 400 and "IMPRECISE" in got[0].info
    assert got[0].qual > 50 and got[0].filter == [] and got[0].format == "GT:FT:GQ:PL:PR:SR" and got[0].samples[0].startswith("1/1:PASS")


def test_workflow_refines_a_small_deletion(spark):
    """Reads over a deletion of 60 bases are aligned with it; assembly gives its exact bases and split reads its genotype."""
    import random

    rng = random.Random(12)
    ref = "".join(rng.choices("ACGT", k=12_000))
    at, gone, n = 6000, 60, 100
    rows = []

    def mapped(p, deleted):
        """Place, CIGAR and bases of a read of a genome with or without the deletion."""
        if not deleted:
            return p, f"{n}M", ref[p : p + n]
        if p + n <= at:
            return p, f"{n}M", ref[p : p + n]
        if p >= at:
            return p + gone, f"{n}M", ref[p + gone : p + gone + n]
        left = at - p
        bases = ref[p:at] + ref[at + gone : at + gone + n - left]
        if left >= 25 and n - left >= 25:
            return p, f"{left}M{gone}D{n - left}M", bases
        return (p, f"{left}M{n - left}S", bases) if left > n - left else (at + gone, f"{left}S{n - left}M", bases)

    for i, start in enumerate(range(0, 11_000, 8)):
        deleted = i % 2 == 0
        size = rng.randrange(250, 350)
        (a, ca, sa), (b, cb, sb) = mapped(start, deleted), mapped(start + size - n, deleted)
        tlen = b + n - a
        for flag, p, c, s, m, t in ((99, a, ca, sa, b, tlen), (147, b, cb, sb, a, -tlen)):
            rows.append((f"f{i}", flag, 0, 0, p, 60, c, 0, m, t, s, [30] * len(s), None, None, {}))
    reads = spark.createDataFrame(rows, "qname string, flag int, sample int, tid int, pos0 int, mapq int, cigar string, mate_tid int, mate_pos0 int, tlen int, seq string, qual array<int>, sa string, mc string, tags map<string,string>")
    contigs = spark.createDataFrame([(0, "ctgOne", 12_000)], "tid int, label string, length int")
    pieces = text.chunked(spark.createDataFrame([("ctgOne", ref)], "label string, bases string"), contigs, margin=20_000)
    got = workflow.run(reads, contigs, pieces=pieces).collect()
    assert len(got) == 1
    r = got[0]
    assert len(r.ref) - len(r.alt) == gone and "IMPRECISE" not in r.info and f"SVLEN=-{gone}" in r.info
    assert ref[: r.pos - 1] + r.alt + ref[r.pos - 1 + len(r.ref) :] == ref[:at] + ref[at + gone :]
    assert r.samples[0].startswith("0/1:PASS") and r.filter == []


def planted_pairs(sample, deleted, rng, gap=2000, at=20_000, n=50):
    """Pairs that tile a contig of 60 kb, with or without a deletion; those over its ends are left out."""
    rows = []
    for i, start in enumerate(range(0, 40_000, 40)):
        size = rng.randrange(180, 320)
        left, right = start, start + size - n
        if deleted and (left < at < left + n or right < at < right + n):
            continue
        move = lambda p: p + gap if deleted and p + n > at else p
        a, b = move(left), move(right)
        for flag, p, m, t in ((99, a, b, b + n - a), (147, b, a, a - b - n)):
            rows.append((f"s{sample}f{i}", flag, sample, 0, p, 60, f"{n}M", 0, m, t, "A" * n, [30] * n, None, None, {}))
    return rows


READS = "qname string, flag int, sample int, tid int, pos0 int, mapq int, cigar string, mate_tid int, mate_pos0 int, tlen int, seq string, qual array<int>, sa string, mc string, tags map<string,string>"


def test_workflow_scores_a_somatic_deletion(spark):
    import random

    rng = random.Random(3)
    reads = spark.createDataFrame(planted_pairs(0, False, rng) + planted_pairs(1, True, rng), READS)
    contigs = spark.createDataFrame([(0, "ctgOne", 60_000)], "tid int, label string, length int")
    (r,) = workflow.run(reads, contigs, workflow.Options(normals=1, tumours=1)).collect()
    score = int(r.info.split("SOMATICSCORE=")[1].split(";")[0])
    assert "SOMATIC;" in r.info and score > 0 and r.filter == ["MinSomaticScore"] * (score < 30) and r.format == "PR:SR" and len(r.samples) == 2
    assert r.samples[0].split(":")[0].endswith(",0") and not r.samples[1].split(":")[0].endswith(",0")


def test_workflow_marks_a_deep_locus(spark):
    """Reads heaped on one breakend are above three times the contig's depth."""
    import random

    rng = random.Random(4)
    rows = planted_pairs(0, True, rng)
    heap = [(f"heap{i}", f, 0, 0, p, 60, "50M", 0, m, t, "A" * 50, [30] * 50, None, None, {}) for i in range(80) for f, p, m, t in ((99, 19_650 + 3 * i, 19_820 + 3 * i, 220), (147, 19_820 + 3 * i, 19_650 + 3 * i, -220))]
    contigs = spark.createDataFrame([(0, "ctgOne", 60_000)], "tid int, label string, length int")
    (r,) = workflow.run(spark.createDataFrame(rows + heap, READS), contigs).collect()
    assert "MaxDepth" in r.filter
