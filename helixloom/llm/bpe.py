"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton finds every vocabulary token in a
piece of text in one pass. Encoding takes the longest token at each position and backtracks to shorter ones
until each two neighbours are compatible. Two tokens are compatible if merging their joined bytes gives just
these two again; that is a property of the pair alone and is memoised. A sequence whose neighbours are all
compatible is the one that the merges give, and positions once found to be dead ends are never entered
again, so the work is linear in the length of the piece.

Defined cases: null text is the empty text; the empty text has no tokens; rows are kept one to one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of one generation of a worker's memory of pieces, and entries of one of token pairs. A piece longer than LONG is not kept.
PIECE_BYTES, PAIRS, LONG = 48 << 20, 200_000, 48
_NEVER = 1 << 60

# Letters and numbers that the installed regex module knows and Unicode 16, which the tokenizer libraries follow, does not.
_LATER_LETTERS = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def _ranges(chars: list[str]) -> str:
    """A class's inside for the standard re module: the characters as ranges."""
    out, codes = [], sorted(map(ord, chars))
    start = 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            out.append(f"\\u{codes[start]:04x}-\\u{codes[i - 1]:04x}")
            start = i
    return "".join(out)


class Splitter:
    """Splits a text into the pieces that are encoded separately.

    Texts within the basic plane, nearly all, go through the standard re module, which is twice as fast with its
    classes written out; the classes are taken from the regex module, less the later letters and numbers.
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.plain = regex.compile(pattern)
        later = f"[{_LATER_LETTERS}{_LATER_NUMBERS}]"
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|LATER)").replace(r" ?\p{L}+", r" ?(?:(?!LATER)\p{L})+").replace(r" ?\p{N}+", r" ?(?:(?!LATER)\p{N})+")
        self.exact = regex.compile(exact.replace("LATER", later))
        self.later = regex.compile(later)
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        letters, numbers = ([c for c in regex.findall(k, plane) if not self.later.match(c)] for k in (r"\p{L}", r"\p{N}"))
        spaces = regex.findall(r"\s", plane)
        basic = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_ranges(letters + numbers + spaces)}]").replace(r"\p{L}", f"[{_ranges(letters)}]").replace(r"\p{N}", f"[{_ranges(numbers)}]")
        basic = basic.replace(r"\S", f"[^{_ranges(spaces)}]").replace(r"\s", f"[{_ranges(spaces)}]")
        self.basic = re.compile(basic)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.basic.findall(text)
        return (self.exact if self.later.search(text) else self.plain).findall(text)


class Memory(dict):
    """What is known of pieces, in two generations: when the young one is full it becomes the old one, so frequent
    pieces stay. Bounded by bytes, whatever the pieces' number. make gives what is not known yet."""

    def __init__(self, make, weigh, limit: int = PIECE_BYTES):
        super().__init__()
        self.make, self.weigh, self.limit = make, weigh, limit
        self.old: dict = {}
        self.held = 0

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONG:
            self.held += 180 + len(piece) + self.weigh(found)  # about what two objects and their place in a dict take
            if self.held >= self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[piece] = found
        return found


class Merges:
    """A byte-level vocabulary by priority: 0 to 255 are single bytes, then one entry for each merge, earliest first.

    tokens: the bytes of each entry. ids: what each entry is called outside. halves: the two entries that each
    merge joins, if the vocabulary file gives them; else they are derived.
    """

    def __init__(self, tokens: list[bytes], ids: list[int], halves: list[tuple[int, int]] | None = None):
        self.tokens, self.ids, self.length = tokens, ids, [len(t) for t in tokens]
        self.index = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.joined: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        for i in range(256, len(tokens)):
            self.left[i], self.right[i] = halves[i - 256] if halves else self._halves(i)
            self.joined.setdefault(self.left[i] << 20 | self.right[i], i)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(tokens)  # the longest token that is a proper prefix
        for i, t in enumerate(tokens):
            for n in range(len(t) - 1, 0, -1):
                if (p := self.index.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
        single = {t: r for r, t in ranked if len(t) == 1}
        tokens = [bytes([i]) for i in range(256)] + [t for _, t in ranked if len(t) > 1]
        return cls(tokens, [single[bytes([i])] for i in range(256)] + [r for r, t in ranked if len(t) > 1])

    def _halves(self, i: int) -> tuple[int, int]:
        """The last two parts of token i under the merges before it: the one pair of earlier tokens that stays apart."""
        t = self.tokens[i]
        for n in range(1, len(t)):
            a, b = self.index.get(t[:n], i), self.index.get(t[n:], i)
            if a < i and b < i and self._apart(a, b):
                return a, b
        raise ValueError(f"no merge gives token {t!r}")

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what merging their bytes gives.

        The tokens at the seam are undone in the reverse order of their making. Each two that face each other at
        some time must not have had a merge that came before the next merge of either. Of equal merges the left
        one comes first.
        """
        until_a = until_b = _NEVER
        joined = self.joined
        while True:
            c = joined.get(a << 20 | b)
            if c is not None and c < until_a and c <= until_b:
                return False
            if a > b:
                if a < 256:
                    return True
                until_a, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                until_b, b = b, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.older_pairs.get(key)
            if found is None:
                found = self._apart(a, b)
            if len(self.pairs) >= PAIRS:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Entries (not ids) of one piece."""
        whole = self.index.get(data)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(data), self.length, self.shorter, self.compatible
        longest = [0] * n
        for end, t in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length[t]] = t  # a start's tokens come by rising end
        out: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0] if n else -1
        while at < n:
            while t >= 0 and (dead[at + length[t]] or out and not compatible(out[-1], t)):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at] if at < n else -1
            else:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
                t = shorter[t]
        return out


class Codec:
    """Encodes and decodes texts by one rank file; one is kept in each Python worker."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.merges = Merges.from_ranks(path)
        self.split = Splitter(pattern)
        names = np.array(self.merges.ids, dtype="<u4")
        self.packed = Memory(lambda piece: names[self.merges.encode_piece(piece.encode("utf-8", "replace"))].tobytes(), len)
        self.bytes_of = dict(zip(self.merges.ids, self.merges.tokens))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", into: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with one more column: the ids of the text as array<int>. A column of that name is replaced."""
    common.ship(df.sparkSession)
    df = df.drop(into)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path(RANKS))  # found where the worker runs
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(at).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "token_ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """df with one more column: the bytes that the ids stand for (null: none)."""
    common.ship(df.sparkSession)
    df = df.drop(into)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path(RANKS))  # found where the worker runs
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of tokens, and hashes of the ids and of what they decode to, for each row of docs."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or public_tokenizers.path(RANKS))  # found where the worker runs
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded by the multilingual ranks and decoded again."""
    return digests(common.read(spark, sf_dir, "documents", "doc_id", "text"))
