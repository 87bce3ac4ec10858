"""Schemas of the tables that the operators read."""

CONTIGS = "tid INT, label STRING, length INT"
ALIGNMENTS = (
    "qname STRING, flag INT, sample INT, tid INT, pos0 INT, mapq INT, cigar STRING, mate_tid INT, mate_pos0 INT, tlen INT, "
    "seq STRING, qual ARRAY<INT>, sa STRING, mc STRING, tags MAP<STRING,STRING>"
)
FRAGMENT_SIZES = "sample INT, size INT, n LONG"
CHROM_DEPTH = "label STRING, depth DOUBLE"
BED = "chrom STRING, begin INT, end INT"
VCF = "chrom STRING, pos INT, id STRING, ref STRING, alt STRING, qual DOUBLE, filter ARRAY<STRING>, info MAP<STRING,STRING>, format ARRAY<STRING>, samples ARRAY<ARRAY<STRING>>"

#: Evidence types, in the order of their places in evidence vectors.
EVIDENCE = ("PAIR", "LOCAL_PAIR", "CIGAR", "SOFTCLIP", "SEMIALIGN", "SHADOW", "SPLIT_ALIGN", "UNKNOWN")
#: Breakend states.
UNKNOWN, RIGHT_OPEN, LEFT_OPEN, COMPLEX = 0, 1, 2, 3
