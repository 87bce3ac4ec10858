"""Sequences as columns: complement, validity, quality, repeat units and words of k bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def standard(s: Column) -> Column:
    """Upper case, with anything but A, C, G, T as N."""
    return F.regexp_replace(F.upper(s), "[^ACGT]", "N")


def is_valid(s: Column) -> Column:
    return ~s.rlike("[^ACGTN]")


def repeat_unit(s: Column) -> Column:
    """The shortest string that s is made of by repetition; s itself if there is none."""
    n = F.length(s)
    size = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n % k == 0) & (F.repeat(F.substring(s, F.lit(1), k), (n / k).cast("int")) == s))
    return F.when(n > 0, F.substring(s, F.lit(1), F.get(size, F.lit(0)))).otherwise(s)


def words(s: Column, k: int) -> Column:
    """All substrings of k characters, in order: a look-ahead at each place, so the text is passed once."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def word_counts(df: DataFrame, keys, s: Column, k: int) -> DataFrame:
    """For each k-mer without N, how many sequences have it; one of a sequence's equal words counts."""
    own = F.array_distinct(F.filter(words(s, k), lambda w: ~w.contains("N")))
    return df.select(*keys, F.explode(own).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def mean_quality(qual: Column) -> Column:
    return F.aggregate(qual, F.lit(0.0), lambda a, q: a + q) / F.size(qual)


def masked(s: Column, qual: Column, least: int) -> Column:
    """Bases below a quality as N."""
    return F.array_join(F.zip_with(F.split(s, ""), qual, lambda b, q: F.when(q < least, "N").otherwise(b)), "")


def homology(s: Column, ref: Column, begin: Column, end: Column) -> Column:
    """How far the range [begin, end) of ref can shift to the right with s unchanged (bases from end equal those from begin)."""
    right = F.substring(ref, end + 1, F.length(ref))
    left = F.substring(ref, begin + 1, F.length(ref))
    same = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(same)) + F.length(s) * 0
