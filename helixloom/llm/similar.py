"""SimHash near-dedup at a similarity of sets: the operator of simhash.py with a long fingerprint and an exact check.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Such sets differ in
about 15 of 100 fingerprint bits, which is too many for 64 bits to tell, so the fingerprint has 64 * WORDS bits.

1. Embedding: its segments of two bits are mapped to their bit counts. 2. Grid: each of some tens of grids has a few of
the segments as axes; documents meet where their counts on a grid's axes are equal. The number of axes follows the
logarithm of the number of documents, and the number of grids follows the axes. 3. Nodes that meet are tied if the
Manhattan distance of the counts of LEAD words, a lower bound of their differing bits, and then these bits are within a
bound; a cell yields a spanning forest of its ties, never all its pairs. Ties whose whole prints differ too much go, and
what the others connect is a block. 4. Within a block, sets are compared exactly through an index of their elements, and
again only a spanning forest of the links is kept.

Equal sets are one node, so copies cost nothing after the first step. Cells and blocks of more than CELL nodes (or
BLOCK_BYTES of text) are dealt out as pairs of parts, so no task holds an unbounded one and no link is lost.

What a fingerprint can miss: pairs at just 0.8 meet in at least one grid with a chance of about 1 - exp(-MEETINGS);
those at 0.85 or more nearly always do. All else is exact.

Defined cases: shingles are hashed to 64 bits, and sets to 64 bits for equality; a text of fewer than five words is one
shingle; texts without words (null ones too) are equal; words are lowered as ASCII; repeated rows are kept by
near_duplicates and are one for one_of_each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import components
from .simhash import embedded, manhattan

SHINGLE, SEED = 5, 42
#: Similarity, as a fraction.
NUM, DEN = 4, 5
#: Words of a fingerprint, and those of them that enter the grids; most bits in which these, and the whole, may differ.
WORDS, LEAD, FIRST, WHOLE = 16, 2, 35, 200
#: Expected number of grids in which two sets of just the similarity meet.
MEETINGS = 3.0
#: Chance that a segment's counts are equal: of sets of just the similarity, and of unrelated ones (3/8).
_NEAR, _FAR = 0.7315, 0.375
#: About how many unrelated nodes may share a cell, and the fewest axes.
STRANGERS, AXES = 128, 12
#: Most nodes of a cell or block, and most bytes of a block's texts, that are compared in one group.
CELL, BLOCK_BYTES = 2048, 16 << 20
#: Groups up to this size are compared all at once, larger ones node by node.
SMALL = 64
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least NUM / DEN; empty sets are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (NUM + DEN) * both >= NUM * (len(x) + len(y))


def print_of(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: the majority of its elements' bits, each word from another mix of their hashes."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 255):
        x = own[at : at + 255, None] * _MIX
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        total += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(own)).view("<u8")


class Grid:
    """The grids for a number of nodes."""

    def __init__(self, nodes: int):
        self.axes = max(AXES, math.ceil(math.log(max(nodes, 2) / STRANGERS) / -math.log(_FAR)))
        self.grids = math.ceil(MEETINGS / _NEAR**self.axes)
        rng = np.random.default_rng(SEED + 1)
        self.segments = np.stack([rng.permutation(32 * WORDS)[: self.axes] for _ in range(self.grids)])
        self.power = 3 ** np.arange(self.axes, dtype=np.int64)

    def cells(self, prints: np.ndarray) -> np.ndarray:
        """The cell in each grid of each print (rows); cells of different grids are different."""
        packed = embedded(prints)
        fields = ((packed[:, :, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3)).astype(np.int64).reshape(len(prints), -1)
        out = np.empty((len(prints), self.grids), np.int64)
        for k, own in enumerate(self.segments):
            out[:, k] = fields[:, own] @ self.power + k * 3**self.axes
        return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether leading words (rows of a and b, or one of them) are near: by the lower bound, then by the bits."""
    bound = manhattan(embedded(a), embedded(b)).sum(axis=-1)
    return (bound <= FIRST) & (np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= FIRST)


def grown(size: int, partners) -> list[tuple[int, int]]:
    """A spanning forest of links among 0 to size - 1; partners(i, left) gives those of left that i is linked to."""
    left, out = np.arange(size), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = partners(i, left)
            if hit.any():
                near = left[hit].tolist()
                out += [(i, j) for j in near]
                queue += near
                left = left[~hit]
    return out


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), node (hash of the set) and print (of whole words, as bytes) of each row of docs."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            node = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), pa.array([print_of(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "version", "node", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, f"doc_id {kind}, version long, node long, print binary")


def _table(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=names)


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows (as columns of an array) that hold whole groups of the sorted first column."""
    held = None
    for batch in batches:
        own = np.stack([c.to_numpy() for c in batch.columns])
        held = own if held is None else np.concatenate([held, own], axis=1)
        whole = int(np.searchsorted(held[0], held[0][-1])) if held.shape[1] else 0
        if whole:
            yield held[:, :whole]
            held = held[:, whole:]
    if held is not None and held.shape[1]:
        yield held


def _ties(groups: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties (by place) of sorted rows: in each group a spanning forest of the near ones."""
    edge = np.append(np.flatnonzero(np.diff(groups, prepend=groups[0] - 1)), len(groups))
    size = np.diff(edge)
    behind = np.repeat(edge[1:], size) - np.arange(len(groups)) - 1
    behind[np.repeat(size > SMALL, size)] = 0
    a, b = [], []
    for step in range(1, int(behind.max()) + 1):
        at = np.flatnonzero(behind >= step)
        at = at[_near(words[at], words[at + step])]
        a += at.tolist()
        b += (at + step).tolist()
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    kept = []
    for i, j in sorted(zip(a, b)):  # the first row takes all that it can, so that cells with the same rows have the same ties
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
    for start, n in zip(edge[:-1][size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = words[start : start + n]
        kept += [(start + i, start + j) for i, j in grown(n, lambda i, left, own=own: _near(own[left], own[i]))]
    return tuple(np.array(kept, np.int64).reshape(-1, 2).T)


def _met(nodes: DataFrame, grid: Grid, cell_size: int) -> DataFrame:
    """a < b: ties between near nodes that share a cell."""
    spark = nodes.sparkSession
    names = ["cell", "node", *(f"w{k}" for k in range(LEAD))]
    schema = ", ".join(f"{c} long" for c in names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = _unpacked(batch.column(1))
            row = np.repeat(np.arange(len(long)), grid.grids)
            yield from _table(names, grid.cells(long).ravel(), batch.column(0).to_numpy()[row], *(long[row, k].view(np.int64) for k in range(LEAD)))

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            words = np.ascontiguousarray(rows[2:].T).view(np.uint64)
            i, j = _ties(rows[0], words)
            x, y = rows[1][i], rows[1][j]
            yield from _table(["a", "b"], *np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))

    rows = nodes.select("node", "print").mapInArrow(entries, schema)
    crowded = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_size)
    crowded = common.stored(crowded.select("cell", F.ceil(F.col("n") / cell_size).cast("int").alias("parts")), "crowded")
    dealt = rows.withColumnRenamed("cell", "deal") if crowded.isEmpty() else _dealt(rows, crowded, "cell", names[1:])
    out = dealt.repartition("deal").sortWithinPartitions("deal", "node").mapInArrow(ties, "a long, b long")
    return common.stored(out.distinct(), "ties")


def _dealt(rows: DataFrame, crowded: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """deal and the columns: rows of crowded keys (key, parts) once for each part that theirs is paired with, others once."""
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    rows = rows.join(common.few(crowded), key, "left").withColumn("part", part).select(key, *columns, "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return rows.select(F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other")).alias("deal"), *columns)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole prints are within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unlike = np.bitwise_count(_unpacked(batch.column(2)) ^ _unpacked(batch.column(3))).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(unlike <= WHOLE))

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("print").alias(f"print_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "print_a", "print_b").mapInArrow(run, "a long, b long")


def similar_among(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the similar ones among sets, through an index of their elements."""
    if len(sets) == 2:
        return [(0, 1)] if similar(*sets) else []
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    element, owner = flat[order], owner[order]

    def partners(i: int, left: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(element, sets[i], "left"), np.searchsorted(element, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))[left]
        return (NUM + DEN) * both >= NUM * (size[i] + size[left])

    return grown(len(sets), partners)


def _verified(blocks: DataFrame, docs: DataFrame, found: DataFrame, cell_size: int) -> DataFrame:
    """a < b: links that connect all similar nodes of each block (node, root)."""
    one = found.join(blocks, "node").groupBy("node").agg(F.min("version").alias("version"), F.first("root").alias("block"))
    texts = docs.select("text", F.xxhash64("text").alias("version")).join(one, "version").groupBy("node").agg(F.first("block").alias("block"), F.first("text").alias("text"))
    texts = common.stored(texts, "texts")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                pairs = [sorted((nodes[i], nodes[j])) for i, j in similar_among(sets)]
                if pairs:
                    yield from _table(["a", "b"], *np.array(pairs, np.int64).T)

        for batch in batches:
            for deal, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if deal != last:
                    yield from close()
                    last, nodes, sets = deal, [], []
                nodes.append(node)
                sets.append(shingles(text))
        yield from close()

    n, size = F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    parts = F.greatest(F.ceil(n / cell_size), F.ceil(size / BLOCK_BYTES)).cast("int").alias("parts")
    crowded = common.stored(texts.groupBy("block").agg(parts).where("parts > 1"), "crowded")
    dealt = _dealt(texts, crowded, "block", ["node", "text"])
    out = dealt.repartition("deal").sortWithinPartitions("deal", "node").mapInArrow(links, "a long, b long")
    out = common.stored(out, "similar")
    common.forget(texts)
    return out


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, version and root (a node that names the component) of each row of docs (doc_id, text)."""
    common.ship(docs.sparkSession)
    found = common.stored(prints(docs), "prints")
    nodes = common.stored(found.groupBy("node").agg(F.first("print").alias("print")), "nodes")
    grid = Grid(nodes.count())
    # a few thousand prints at a time: each enters all grids
    nodes = nodes.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("node"))
    ties = _met(nodes, grid, cell)
    blocks = common.stored(components(_bounded(ties, nodes)), "blocks")
    roots = common.stored(components(_verified(blocks, docs, found, cell)), "roots")
    for df in (ties, blocks):
        common.forget(df)
    return found.join(roots, "node", "left").select("doc_id", "version", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the least doc_id (then version) stays, once."""
    return common.least_of_each(docs, near_duplicates(docs.select("doc_id", "text"), **options))
