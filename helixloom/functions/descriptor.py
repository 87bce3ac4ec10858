"""Match descriptors: matches as numbers, mismatched reference bases as letters, indels between ^ and $ (deleted bases as
letters, the length of an insertion as a number). Written in the direction of the read."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .align import _pack, reversed_cigar

_PART = re.compile(r"(\d+)|([ACGTNacgtn])|\^([^$]*)\$")
_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def to_cigar(descriptor: str, forward: bool = True, edge_deletion_is_error: bool = True) -> str:
    """The CIGAR of a descriptor, on the forward strand."""
    ops, at = [], 0
    for m in _PART.finditer(descriptor):
        if m.start() != at:
            break
        at = m.end()
        if m[1]:
            ops.append(("M", int(m[1])))
        elif m[2]:
            ops.append(("M", 1))
        else:
            for n, bases in re.findall(r"(\d+)|([ACGTNacgtn]+)", m[3]):
                ops.append(("I", int(n)) if n else ("D", len(bases)))
    if at != len(descriptor):
        raise ValueError(f"can't parse match descriptor {descriptor!r} at {at}")
    cigar = _pack(ops)
    edges = re.match(r"^\d+D", cigar) or re.search(r"M\d+D$|I\d+D$", cigar)
    if edges and edge_deletion_is_error:
        raise ValueError(f"alignment path {cigar} has a deletion at its edge")
    return cigar if forward else reversed_cigar(cigar)


def from_cigar(cigar: str, pos: int, read: str, ref: str, forward: bool = True) -> str:
    """The descriptor of a read aligned at pos of ref; the read's edges may be clipped."""
    parts: list[str] = []
    run = 0
    q, r = 0, pos

    def close():
        nonlocal run
        if run:
            parts.append(str(run))
            run = 0

    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            for k in range(n):
                if read[q + k] == ref[r + k]:
                    run += 1
                else:
                    close()
                    parts.append(ref[r + k])
            q, r = q + n, r + n
        elif op == "I":
            close()
            parts.append(f"^{n}$")
            q += n
        elif op in "DN":
            close()
            parts.append(f"^{ref[r:r + n]}$")
            r += n
        elif op == "S":
            q += n
    close()
    if forward:
        return "".join(parts)
    turned = [f"^{p[1:-1].translate(_COMPLEMENT)[::-1] if p[1].isalpha() else p[1:-1]}$" if p[0] == "^" else p.translate(_COMPLEMENT) for p in reversed(parts)]
    return "".join(turned)


@F.pandas_udf(StringType())
def descriptor_cigars(descriptor: pd.Series, forward: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else to_cigar(d, bool(f)) for d, f in zip(descriptor, forward)])
