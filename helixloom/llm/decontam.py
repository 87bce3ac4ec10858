"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (ten consecutive words; a shorter item is one window) are sets of word shingles. A window can
only occur where its rarest shingle occurs, so that one shingle is its necessary prefix: shingles are ordered by
how often they are in all documents, and only places of prefix shingles are joined with it. A candidate gives the
place where the window would start, which must lie within the document (positional and length bounds), and is
verified word by word over the item-sized window, from the words about its place.

Items stay a table. Workers only get a map of MAP_BITS bits of the shingles that matter, of a fixed size whatever the
benchmark's, so that documents send on few places that are not prefixes; the join decides. A large benchmark makes
the map less selective, never the result wrong. The corpus is read twice, for counts and for places, at any size.

Defined cases: null and empty texts have no words; an item without words has no windows; a null item_id is
written as "null"; repeated rows of documents are judged apart, repeated item ids are one item; an empty table
gives no rows (documents) or no hits (items). Equal texts are judged once and share the result by a hash of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from . import common

WINDOW, SHINGLE = 10, 3
#: Bits of the map of shingles that workers hold (2 MB).
MAP_BITS = 1 << 24

#: Lower-cases A-Z; ASCII characters other than letters and digits separate words.
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def codes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of the shingle of so many words that starts at each place."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and words (joined by spaces) of each window of each item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode("utf-8", "replace") for w in words_of(text)]
                found = [" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1) if words else 0)]
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.string())], names=["item_id", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.encode("text", "UTF-8").alias("text"))
    return named.mapInArrow(run, "item_id string, words string").distinct()


def _shingles(wins: DataFrame) -> DataFrame:
    """words, shingle and at (the place in the window) of each shingle of distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found, at = [], [], []
            for text in batch.column(0).to_pylist():
                own = text.encode().split()
                hashes = codes(own, min(SHINGLE, len(own))).view(np.int64).tolist()
                words += [text] * len(hashes)
                found += hashes
                at += range(len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found, pa.int64()), pa.array(at, pa.int32())], names=["words", "shingle", "at"])

    return wins.select("words").distinct().mapInArrow(run, "words string, shingle long, at int")


def _map(shingles: DataFrame) -> bytes:
    """One bit for each shingle's hash modulo MAP_BITS; what comes to the driver has MAP_BITS bits whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(MAP_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        part = np.flatnonzero(bits.reshape(-1, 4096).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([bits[4096 * p : 4096 * p + 4096].tobytes() for p in part], pa.binary())], names=["part", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(b, np.uint8)
                parts[p] = parts[p] | own if p in parts else own
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    bits = bytearray(MAP_BITS // 8)
    rows = shingles.select("shingle").mapInArrow(run, "part long, bits binary").repartition("part").mapInArrow(joined, "part long, bits binary").collect()
    for r in rows:
        bits[4096 * r.part : 4096 * (r.part + 1)] = r.bits
    return bytes(bits)


def _known(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = found % np.uint64(8 * len(bits))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(texts: DataFrame, sizes: list[int], shared) -> DataFrame:
    """shingle and n: how often the shingles of the map are in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            parts = [c[_known(c, bits)] for t in batch.column(0).to_pylist() if (words := words_of(t)) for size in sizes for c in (codes(words, size),)]
            found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


_PLACES = "k1 long, k2 long, at int, n_words int, shingle long, before string, behind string"


def _places(texts: DataFrame, sizes: list[int], shared, window: int) -> DataFrame:
    """Of texts (text, k1, k2): the places of the map's shingles, with the words about them (before and from there on, with spaces around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            rows: list[tuple] = []
            for text, k1, k2 in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                for size in sizes:
                    found = codes(words, size)
                    for i in np.flatnonzero(_known(found, bits)).tolist():
                        before, behind = b" ".join(words[max(0, i - window + 1) : i]), b" ".join(words[i : i + window])
                        rows.append((k1, k2, i, len(words), int(found[i].view(np.int64)), f" {before.decode()} " if before else " ", f" {behind.decode()} "))
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in _PLACES.split(", ")])

    return texts.mapInArrow(run, _PLACES)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def found_in(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1 and k2 (hashes of the text), hit_words (places of hit words, rising) and hit_items (sorted ids) of texts with a hit; stored."""
    spark = docs.sparkSession
    common.ship(spark)
    own = common.stored(windows(items, window), "windows")
    shingles = common.stored(_shingles(own), "shingles")
    # a shorter window's shingles are of its own length: at most three sizes
    sizes = sorted(r[0] for r in shingles.select(F.least(F.size(F.split("words", " ")), F.lit(SHINGLE)).alias("size")).distinct().collect())
    texts = docs.where(F.col("text").isNotNull()).select(F.encode("text", "UTF-8").alias("text"), *_keys(F.col("text")))
    shared = spark.sparkContext.broadcast(_map(shingles))
    counted = _counted(texts.select("text"), sizes, shared).join(shingles.select("shingle").distinct(), "shingle", "left_semi")
    counted = common.stored(counted, "counted")
    # the rarest shingle of each window; one that is nowhere rules the window out
    ordered = shingles.join(counted, "shingle", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("rarest")).where("rarest.n > 0")
    parts = F.split("words", " ")
    offset, size = F.col("rarest.at"), F.size(parts)
    spaced = lambda some: F.when(F.size(some) > 0, F.concat(F.lit(" "), F.array_join(some, " "), F.lit(" "))).otherwise(" ")
    prefixes = ordered.select("words", F.col("rarest.shingle").alias("prefix"), offset.alias("offset"), size.alias("size"), spaced(F.slice(parts, 1, offset)).alias("left"), spaced(F.slice(parts, offset + 1, size)).alias("right"))
    prefixes = common.stored(prefixes, "prefixes")
    only = spark.sparkContext.broadcast(_map(prefixes.select(F.col("prefix").alias("shingle"))))
    places = common.stored(_places(texts, sizes, only, window), "places")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.col("before").endswith(F.col("left")) & F.col("behind").startswith(F.col("right"))
    joined = places.join(prefixes, F.col("shingle") == F.col("prefix")).where(inside & same)
    met = common.stored(joined.select("k1", "k2", start.alias("start"), "size", "words").distinct(), "met")
    covered = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size")).alias("ranges"))
    covered = covered.select("k1", "k2", F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))).alias("hit_words"))
    named = met.select("k1", "k2", "words").distinct().join(own, "words").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("hit_items"))
    out = common.stored(covered.join(named, ["k1", "k2"]), "hits")
    for df in (own, shingles, counted, prefixes, places, met):
        common.forget(df)
    shared.unpersist()
    only.unpersist()
    return out


def _joined(docs: DataFrame, items: DataFrame, window: int, *more: Column) -> DataFrame:
    """row (a struct of the columns of docs), more, hit_words and hit_items (null without a hit)."""
    found = found_in(docs, items, window).withColumnsRenamed({"k1": "f1", "k2": "f2"})
    rows = common.boxed(docs, *_keys(F.col("text")), *more)
    # texts are not shuffled if those with hits are counted few
    return rows.join(common.few(found, places=True), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").drop("k1", "k2", "f1", "f2")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_words (places of hit words, rising) and hit_items (sorted ids); such names are replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "hit_words", "hit_items")])
    joined = _joined(docs, items, window, F.encode("text", "UTF-8").alias("bytes"))
    own = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    columns = [F.col("row")[c].alias(c) for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch.columns)
            places, ids = (pa.array([x or [] for x in batch.column(n - k).to_pylist()], kind) for k, kind in ((2, pa.list_(pa.int32())), (1, pa.list_(pa.string()))))
            counts = pa.array([len(words_of(t)) for t in batch.column(n - 3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], counts, places, ids], names=[*batch.schema.names[: n - 3], *(f.name for f in own)])

    flat = joined.select(*columns, F.col("bytes").alias("n_words"), "hit_words", "hit_items")
    return flat.mapInArrow(run, T.StructType([*docs.schema.fields, *own]))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit."""
    return common.unboxed(_joined(docs, items, window).where("hit_words IS NULL"), docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and the items that have them."""
    found = hits(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS n FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM dw),
hit AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.s = win.s AND g.n = win.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
