"""SimHash near-dedup by segment popcounts.

A fingerprint's 64 bits are 32 segments of two bits. The vector of the segments' bit counts is the embedding;
the Manhattan distance of two vectors is never above the Hamming distance of the fingerprints. The vectors are
laid on a grid whose axes are the segments in BLOCKS blocks. Two vectors at distance of at most RADIUS differ
in at most RADIUS blocks, so they share a grid cell in some choice of BLOCKS - RADIUS blocks: each fingerprint
enters one cell for each choice, and cells are joined on equality. Within a cell, fingerprints are sorted by
total bit count; those within the bound of it are compared by the Manhattan distance of all 32 counts, a lower bound
too, and then verified by the exact Hamming distance.

Equal fingerprints are one node. A cell yields a spanning forest of its links, not all its pairs. A cell of more
than CELL fingerprints is dealt out as pairs of blocks of its rows, each pair to its own group, so no task
holds an unbounded cell and no link is lost.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows are kept;
a component's id is the smallest non-null doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS = 8
_LOW = np.uint64(0x5555555555555555)
#: Most fingerprints of a cell that are compared in one group; larger cells are dealt out in blocks of this size.
CELL = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned integer: majority bits of the hashes of word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        total += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version (hash of the text) and fp (the fingerprint as a signed long) of each row of docs."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "version", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version long, fp long")


def _masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits of its segments, as a signed long."""
    segments = np.array_split(np.arange(32), blocks)
    out = []
    for choice in combinations(range(blocks), blocks - radius):
        mask = sum(3 << (2 * int(s)) for b in choice for s in segments[b])
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def cells(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """choice, cell and fp: each fingerprint in each of its grid cells."""
    fp = F.col("fp")
    # the two-bit fields of this long are the segments' bit counts
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    nodes = nodes.select("fp", counts.alias("counts"))
    return nodes.select(F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m).cast("long")) for m in _masks(blocks, radius)])).alias("choice", "cell"), "fp")


def embedded(fps: np.ndarray) -> np.ndarray:
    """The embedding, packed: the two-bit fields are the segments' bit counts."""
    low, high = fps & _LOW, (fps >> np.uint64(1)) & _LOW
    return (low ^ high) | ((low & high) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: fields that differ by one have their low bits unlike, 0 and 2 do not."""
    x = a ^ b
    one = x & _LOW
    two = (x >> np.uint64(1)) & _LOW & ~one
    return np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count(two)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (by place in fps, which rises by bit count) that connect just what links of at most radius bits connect."""
    n = len(fps)
    ones, counts = np.bitwise_count(fps).astype(np.int16), embedded(fps)
    left = np.arange(n)  # not reached yet
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            lo, hi = np.searchsorted(ones[left], (ones[at] - radius, ones[at] + radius + 1))
            near = left[lo:hi]
            near = near[manhattan(counts[near], counts[at]) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= radius]
            if len(near):
                out += [(at, int(x)) for x in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return out


def _linked(groups: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links of sorted rows: groups numbers each row's group, fps rises by bit count within a group."""
    n = len(fps)
    edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-1)) if n else np.array([0])
    sizes = np.diff(edges)
    a, b = [], []
    # rows of small groups meet the rows just behind them, all groups at once
    two = edges[:-1][sizes == 2]
    hit = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
    a.append(fps[hit])
    b.append(fps[hit + 1])
    for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = fps[start : start + size]
        if links := forest(own, radius):
            x = np.array(links)
            a.append(own[x[:, 0]])
            b.append(own[x[:, 1]])
    pairs = np.stack([np.concatenate(a), np.concatenate(b)]).view(np.int64)
    return np.unique(np.sort(pairs, axis=0), axis=1)


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """a < b: links between distinct fingerprints (fp) that connect all within radius bits of each other."""
    spark = nodes.sparkSession
    common.ship(spark, rows=10_000)
    # fingerprints are few bytes but enter many cells: they are spread first, as Spark would merge their partitions into few tasks; by another hash, or it would drop the step
    entries = cells(nodes.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")), radius, blocks)
    crowded = entries.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / cell).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    dealt = (
        # Spark takes the entries for as small as the fingerprints that they come from, and would broadcast them all
        entries.join(crowded.hint("merge"), ["choice", "cell"])
        .withColumn("parts", parts)
        .withColumn("part", part)
        .select("choice", "cell", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(F.xxhash64("choice", "cell", F.least("part", "other"), F.greatest("part", "other")).alias("deal"), "fp", F.bit_count("fp").alias("ones"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, fp = np.array([], np.int64), np.array([], np.int64)
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])
        for batch in batches:
            deal = np.concatenate([deal, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(deal, deal[-1])) if len(deal) else 0  # the last group may go on in the next batch
            if whole:
                yield out(_linked(deal[:whole], fp[:whole].view(np.uint64), radius))
                deal, fp = deal[whole:], fp[whole:]
        if len(deal):
            yield out(_linked(deal, fp.view(np.uint64), radius))

    return dealt.repartition("deal").sortWithinPartitions("deal", "ones", "fp").select("deal", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """doc_id, version, fp, root (a fingerprint that names the component) and component_id of each row of docs (doc_id, text)."""
    prints = common.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = common.stored(components(links(nodes.select("fp"), radius, blocks, cell)), "roots")
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = common.stored(named.join(ids, "root").select("fp", "root", "component_id"), "components")
    return prints.join(of_fp, "fp").select("doc_id", "version", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the least doc_id (then version) stays, once."""
    return common.least_of_each(docs, near_duplicates(docs.select("doc_id", "text"), **options))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
