"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are found by fixed patterns, leftmost and non-overlapping for each kind;
a match that fails its check is dropped and not retried. The method adds kinds whose pattern alone is too weak:
a proposal starts from its pattern's score, a checksum (Luhn, or mod 97) raises it, words near it raise or lower
it, and it stays from THRESHOLD on. An added span never touches a base span.

Defined cases: null text is the empty text with no spans; offsets are code points, end exclusive; rows are kept
one to one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "plain_phone", "national_id")
#: A proposal's score must reach this; context within NEAR characters before or after counts once.
THRESHOLD, NEAR = 0.7, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a match can only start where a run of digits does, and runs need no second try, so long runs cost their length
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_PLAIN_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Score of the pattern alone, what its checksum adds, what a context word adds.
_SCORES = {"iban": (0.3, 0.5, 0.2), "short_card": (0.1, 0.4, 0.3), "plain_phone": (0.4, 0.0, 0.4), "national_id": (0.4, 0.0, 0.4)}
_CONTEXT = {
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte)\b", re.I),
    "short_card": re.compile(r"\b(?:card|credit|visa|amex|mastercard|karte|tarjeta|carte)\b", re.I),
    "plain_phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
    "national_id": re.compile(r"\b(?:ssn|social|security|identity|passport|id)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:order|invoice|isbn|serial|tracking|version|example)\b", re.I)
_PENALTY = 0.3


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, found from each @: the local part is the run before it, as no earlier start can match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(_LOCAL))
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        floor = end
        at = text.find("@", end)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds."""
    out: dict[str, list[tuple[int, int]]] = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end and whether a checksum confirms it."""
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span(), True
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 15 and luhn(d):
            yield "short_card", *m.span(), True
    for kind, pattern in (("plain_phone", _PLAIN_PHONE), ("national_id", _NATIONAL_ID)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    alone, checksum, context = _SCORES[kind]
    near = f"{text[max(0, start - NEAR) : start]} \n {text[end : end + NEAR]}"
    return alone + checksum * confirmed + context * bool(_CONTEXT[kind].search(near)) - _PENALTY * bool(_AGAINST.search(near))


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of all kinds, by kind as listed, each kind by start."""
    text = text or ""
    out = base_spans(text) | {k: [] for k in ADDED}
    if _DIGIT.search(text):
        starts, ends = [], []  # the base spans, those that meet as one
        for a, b in sorted(x for k in BASE for x in out[k]):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for kind, start, end, confirmed in _proposals(text):
            after = bisect_right(ends, start)
            free = after == len(starts) or starts[after] >= end
            if free and score(text, kind, start, end, confirmed) >= THRESHOLD - 1e-9:
                out[kind].append((start, end))
    return out


def written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of spans that meet, the first names the whole."""
    if text is None:
        return None
    merged: list[list] = []
    for a, b, k in sorted((a, b, k) for k, own in find(text).items() for a, b in own):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans in the text column masked; all other columns and all rows stay."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([masked(x) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans and all spans, for each row of docs."""
    common.ship(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([len(x[k]) for x in found], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(written(x, BASE).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, digest, pa.array([written(x, BASE + ADDED) for x in found], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text of documents."""
    return spans(common.read(spark, sf_dir, "documents", "doc_id", "text"))
