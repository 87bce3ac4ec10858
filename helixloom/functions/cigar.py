"""CIGAR strings as columns: arrays of (op, len), lengths, limits and edits, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "([0-9]+)([MIDNSHP=X])"
#: Operations that use up read bases, reference bases, and both.
READ, REF, MATCH = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X"), ("M", "=", "X")
_TYPE = "array<struct<op:string,len:int>>"
_STARTS = "array<struct<op:string,len:int,read:int,ref:int>>"


def once(value: Column, f) -> Column:
    """f of value, worked out once a row however often f names it; inside a lambda an expression is else worked out anew for each element and each mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse(cigar: Column) -> Column:
    """array<struct<op,len>> of a CIGAR string; '*' and null are empty; anything else that doesn't parse raises."""
    text = F.when(cigar.isNull() | (cigar == "*"), F.lit("")).otherwise(cigar)
    whole = text.rlike(r"^(?:[0-9]+[MIDNSHP=X])*\z")
    lens, ops = F.regexp_extract_all(text, F.lit(PATTERN), 1), F.regexp_extract_all(text, F.lit(PATTERN), 2)
    out = F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    return F.when(whole, out).otherwise(F.raise_error(F.concat(F.lit("Can't parse CIGAR string: "), text)))


def text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["len"].cast("string"), s["op"])), "")


def _total(path: Column, ops) -> Column:
    return F.aggregate(path, F.lit(0), lambda a, s: a + F.when(s["op"].isin(*ops), s["len"]).otherwise(0))


def read_length(path: Column) -> Column:
    return _total(path, READ)


def ref_length(path: Column) -> Column:
    return _total(path, REF)


def matched_length(path: Column) -> Column:
    return _total(path, MATCH)


def spliced_length(path: Column) -> Column:
    return _total(path, ("N",))


def indel_count(path: Column) -> Column:
    """Runs of successive insertions and deletions."""
    indel = lambda s: s["op"].isin("I", "D")
    return F.size(F.filter(path, lambda s, i: indel(s) & ((i == 0) | ~F.coalesce(indel(F.get(path, i - 1)), F.lit(False)))))


def exon_count(path: Column) -> Column:
    return F.size(F.filter(path, lambda s: s["op"] == "N")) + 1


def _lead(path: Column, ops) -> Column:
    """Summed length of `ops` before the first other operation."""
    start = F.struct(F.lit(True).alias("go"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct((a["go"] & s["op"].isin(*ops)).alias("go"), F.when(a["go"] & s["op"].isin(*ops), a["n"] + s["len"]).otherwise(a["n"]).alias("n"))
    return F.aggregate(path, start, step, lambda a: a["n"])


def clip_lead(path: Column) -> Column:
    return _lead(path, ("S", "H"))


def clip_trail(path: Column) -> Column:
    return _lead(F.reverse(path), ("S", "H"))


def soft_clip_lead(path: Column) -> Column:
    """Soft clip at the start, a hard clip before it skipped."""
    return _total(F.slice(path, 1, _edge(path)), ("S",))


def soft_clip_trail(path: Column) -> Column:
    back = F.reverse(path)
    return _total(F.slice(back, 1, _edge(back)), ("S",))


def _edge(path: Column) -> Column:
    """How many operations stand before the first match; all of them if there is none."""
    at = F.array_position(F.transform(path, lambda s: s["op"].isin(*MATCH)), True).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(path))


def unaligned_prefix(path: Column) -> Column:
    """Read bases before the first match: clips and edge insertions."""
    return _total(F.slice(path, 1, _edge(path)), READ)


def unaligned_suffix(path: Column) -> Column:
    back = F.reverse(path)
    return _total(F.slice(back, 1, _edge(back)), READ)


def insert_lead(path: Column) -> Column:
    return _total(F.slice(path, 1, _edge(path)), ("I",))


def insert_trail(path: Column) -> Column:
    back = F.reverse(path)
    return _total(F.slice(back, 1, _edge(back)), ("I",))


def _appended(out: Column, op: Column, n: Column) -> Column:
    """out with n bases of op at its end, in its last operation if that is the same; as it is if n is not above 0."""
    last = F.get(out, F.size(out) - 1)
    grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(op.alias("op"), (last["len"] + n).alias("len"))))
    return F.when(n > 0, F.when(last["op"] == op, grown).otherwise(F.concat(out, F.array(F.struct(op.alias("op"), n.alias("len")))))).otherwise(out)


def joined(path: Column, named=lambda op: op) -> Column:
    """Neighbours of one operation as one, without operations of length zero. named: what each operation is called first."""
    return F.aggregate(path, F.array().cast(_TYPE), lambda a, s: _appended(a, named(s["op"]), s["len"]))


def collapsed_matches(path: Column) -> Column:
    """= and X as M."""
    return joined(path, lambda op: F.when(op.isin("=", "X"), "M").otherwise(op))


def with_starts(path: Column) -> Column:
    """array<struct<op,len,read,ref>>: each operation with the read and reference bases before it, in one pass."""
    grown = lambda a, s, n, ops: (a[n] + F.when(s["op"].isin(*ops), s["len"]).otherwise(0)).alias(n)
    own = lambda a, s: F.array(F.struct(s["op"].alias("op"), s["len"].alias("len"), a["read"].alias("read"), a["ref"].alias("ref")))
    start = F.struct(F.array().cast(_STARTS).alias("out"), F.lit(0).alias("read"), F.lit(0).alias("ref"))
    step = lambda a, s: F.struct(F.concat(a["out"], own(a, s)).alias("out"), grown(a, s, "read", READ), grown(a, s, "ref", REF))
    return F.aggregate(path, start, step, lambda a: a["out"])


def _limited(path: Column, begin: Column, end: Column, ops) -> Column:
    """The path between two places, counted in the bases that `ops` use up; other operations stay if they lie strictly inside. One pass."""

    def within(w: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            at, counts = a["at"], s["op"].isin(*ops)
            cut = F.least(at + s["len"], w["end"]) - F.greatest(at, w["begin"])
            n = F.when(counts, cut).when((at > w["begin"]) & (at < w["end"]), s["len"]).otherwise(0)
            return F.struct((at + F.when(counts, s["len"]).otherwise(0)).alias("at"), _appended(a["out"], s["op"], n).alias("out"))

        return F.aggregate(path, F.struct(F.lit(0).alias("at"), F.array().cast(_TYPE).alias("out")), step, lambda a: a["out"])

    return once(F.struct(begin.alias("begin"), end.alias("end")), within)


def limited_to_read(path: Column, begin: Column, end: Column) -> Column:
    """The path of read bases [begin, end); operations without read bases stay if they lie strictly inside."""
    return _limited(path, begin, end, READ)


def limited_to_ref(path: Column, begin: Column, end: Column) -> Column:
    """The path of reference bases [begin, end), counted from the path's start."""
    return _limited(path, begin, end, REF)


def invalid_reason(path: Column, size: Column) -> Column:
    """Why a path does not fit a read of this size, or null."""
    ops = F.transform(path, lambda s: s["op"])
    inside = F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0)))
    return (
        F.when(F.size(path) == 0, "empty")
        .when(F.exists(path, lambda s: s["len"] <= 0), "zero length")
        .when(F.exists(path, lambda s: s["op"] == "P"), "padding")
        .when(F.exists(inside, lambda s: s["op"] == "H"), "clipping inside")
        .when(~F.exists(path, lambda s: s["op"].isin(*MATCH)), "no match")
        .when(read_length(path) != size, "wrong length")
        .when(F.exists(F.zip_with(ops, F.slice(ops, 2, F.size(ops)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))), "repeated operation")
    )


def matchified(path: Column) -> Column:
    """Soft clips at the edges as matches, joined with the matches beside them."""
    return joined(path, lambda op: F.when(op == "S", "M").otherwise(op))


def matchified_start(pos: Column, path: Column) -> Column:
    return pos - soft_clip_lead(path)
