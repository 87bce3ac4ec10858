"""Token counts by prefix dynamic programming.

For each piece of text, count[i] is the exact number of tokens of its first i bytes and last[i] the last of
them. A token ending at i is the last one if it is compatible with last[] where it starts (see bpe.Merges);
just one is. The table answers how many tokens any prefix has, where a budget of tokens ends and whether a
limit is passed, with no text encoded twice.

Defined cases: null text is the empty text with no tokens; the special token's string counts as one token;
rows are kept one to one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .bpe import Memory, Merges, Splitter

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_json(path: str) -> tuple[Merges, list[str]]:
    """The merges of a tokenizers file and the strings of its special tokens."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    alphabet, vocab = _byte_alphabet(), whole["model"]["vocab"]
    raw = lambda s: bytes(alphabet[c] for c in s)
    tokens = [bytes([b]) for b in range(256)]
    named = {b: c for c, b in alphabet.items()}
    ids = [vocab[named[b]] for b in range(256)]
    index, halves = {t: i for i, t in enumerate(tokens)}, []
    for merge in whole["model"]["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        joined = raw(a) + raw(b)
        if joined not in index:
            halves.append((index[raw(a)], index[raw(b)]))
            index[joined] = len(tokens)
            tokens.append(joined)
            ids.append(vocab[a + b])
    return Merges(tokens, ids, halves), [t["content"] for t in whole["added_tokens"]]


class Counter:
    """Counts tokens of texts and of all their prefixes."""

    def __init__(self, path: str):
        self.merges, self.special = load_json(path)
        self.split = Splitter()
        self.counts = Memory(lambda piece: self.table(piece.encode("utf-8", "replace"))[-1], lambda n: 0)

    def table(self, data: bytes) -> list[int]:
        """count[i] for i from 0 to len(data), of one piece."""
        n, length, compatible = len(data), self.merges.length, self.merges.compatible
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for end, t in self.merges.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[t]
                if start == 0 or compatible(last[start], t):
                    last[end], count[end] = t, count[start] + 1
        return count

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and these."""
        parts = [(text, False)]
        for token in self.special:
            cut = []
            for part, special in parts:
                if special or token not in part:
                    cut.append((part, special))
                    continue
                for i, x in enumerate(part.split(token)):
                    cut += [(token, True)] * (i > 0) + [(x, False)] * bool(x)
            parts = cut
        return parts

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get = self.counts.__getitem__
        return sum(1 if special else sum(map(get, self.split(part))) for part, special in self.segments(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for each i from 0 to len(text), each as if that prefix stood alone."""
        out, base = [0], 0
        before = ""
        for part, special in self.segments(text):
            if special:
                # an unfinished special token is plain text and joins what stands before it
                out += [base - self.count(before) + self.count(before + part[:i]) for i in range(1, len(part))] + [base + 1]
                base, before = base + 1, ""
            else:
                out += [base + n for n in self._plain(part)]
                base, before = out[-1], part
        return out

    def _plain(self, text: str) -> list[int]:
        """Tokens of text[:i] for i from 1, without special tokens.

        A prefix splits like the whole text up to the piece that it ends in, but for two cases: white space at a
        prefix's end is one piece, and an unfinished contraction is a mark and a letter.
        """
        out, base = [], 0
        run, run_base = "", 0  # white space that ends just here, and the tokens before it
        for piece in self.split(text):
            lead = len(piece) - len(piece.lstrip())
            whole = piece == piece[:lead]
            if lead:
                run_base = run_base if run else base
                run += piece[:lead]
                table = self.table(run.encode())
                ends = [len(run[: len(run) - lead + i + 1].encode()) for i in range(lead)]
                out += [run_base + table[e] for e in ends]
            if not whole:
                data = piece.encode("utf-8", "replace")
                table = self.table(data)
                at = len(piece[:lead].encode())
                for c in piece[lead:]:
                    at += len(c.encode("utf-8", "replace"))
                    out.append(base + table[at])
                if piece in _CONTRACTIONS:
                    out[-2] = base + 2
                run = ""
            base += self.counts[piece]
        return out

    def fit(self, text: str, budget: int) -> int:
        """The length of the longest prefix of text that has at most budget tokens."""
        counts = self.prefix_counts(text)
        return max(i for i, n in enumerate(counts) if n <= budget) if budget >= 0 else 0

    def fit_fast(self, text: str | None, budget: int) -> tuple[int, int]:
        """Number of tokens, and fit(): only the pieces about the place where the budget ends get their prefixes."""
        if not text:
            return 0, 0
        segments = self.segments(text)
        if len(segments) > 1 or segments[0][1]:
            n = self.count(text)
            return n, len(text) if n <= budget else self.fit(text, budget)
        pieces = self.split(text)
        ends = list(accumulate(map(self.counts.__getitem__, pieces)))
        n = ends[-1] if ends else 0
        if n <= budget:
            return n, len(text)
        first = next(i for i, e in enumerate(ends) if e > budget)
        while first and (pieces[first].isspace() or pieces[first - 1].isspace()):
            first -= 1
        base = ends[first - 1] if first else 0
        last, end = first, len(text)
        while last < len(pieces) and (ends[last] <= budget or last < first + 3 or pieces[last - 1].isspace()):
            last += 1
        start = sum(map(len, pieces[:first]))
        tail = "".join(pieces[first : last + 1])
        counts = [base, *(base + x for x in self._plain(tail))]
        return n, min(end, start + max((i for i, x in enumerate(counts) if x <= budget), default=0))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within the limit)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or public_tokenizers.path(VOCABULARY))  # found where the worker runs
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [own.fit_fast(x, limit) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len((x or "").encode("utf-8", "surrogatepass")) for x in texts], pa.int64()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([n > limit for n, _ in found], pa.bool_()),
                    pa.array([k for _, k in found], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, counted by the English byte-level vocabulary."""
    return count_tokens(common.read(spark, sf_dir, "documents", "doc_id", "text"))
