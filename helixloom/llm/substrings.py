"""Substring dedup by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; a word goes if a window that covers it also starts
earlier. Only suffixes that start at anchors are indexed: an anchor is the place with the least hash of PREFIX
words among the places of a window, so equal windows have their anchors at the same place. A suffix is taken
with the words before it, so a window is some words left of an anchor and the rest right of it.

1. Anchors whose prefix of PREFIX words occurs once cannot be in a repeat; prefixes are counted and those
   anchors dropped. Only hashes and places move here, no text.
2. The remaining suffixes (words right of the anchor, words left of it) are cut out of the texts. Equal ones are
   aggregated to their first place before anything else, so a passage that a third of all documents share is
   one suffix.
3. Suffixes are dealt by prefix. A prefix with up to GROUP distinct suffixes is one subtree, built in one task:
   suffixes are sorted, neighbours' common lengths give the tree's inner nodes, and a node deep enough, split by
   the words to the left, is a repeat; its first place stays. A prefix with more is made longer, up to a whole
   window, where the first place is an aggregate that needs no tree.
4. What goes is joined back to the suffixes' places, gathered by document, and joined to the texts.

Defined cases: null text has no words; fewer than WINDOW words are no window; a null doc_id counts as the
smallest; rows with equal doc_id and text start at the same place, so neither is earlier and all are treated
alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common

WINDOW, PREFIX = 20, 8
#: Most distinct suffixes of a prefix that one task builds a subtree of.
GROUP = 4096
_LEAST_DOC = -(1 << 63)


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()


def anchors(words: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a document, and the hashes of their prefixes."""
    n = len(words)
    if n < window:
        return np.array([], np.int64), np.array([], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    m = n - prefix + 1
    p = np.zeros(m, np.uint64)
    for j in range(prefix):
        p = (p ^ h[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        p ^= p >> np.uint64(29)
    span = window - prefix + 1  # places in a window
    best, width = np.arange(m), 1
    while width < span:  # the place with the least hash (the first, if some are equal) in growing spans
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        best = np.where(p[b] < p[a], b, a)
        width += step
    at = np.unique(best)
    return at, p[at]


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def subtree(suffixes: list[tuple[list[bytes], list[bytes], tuple]], window: int = WINDOW, prefix: int = PREFIX) -> list[int]:
    """For each suffix (its words, the words left of it, its place), the offsets that are repeats of an earlier place, as bits.

    Bit o stands for the window that begins o words left of the suffix. Places differ by document and start; a
    window's place is the suffix's place less o, so places are compared as they are.
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][0])
    shared = [0] + [_common(suffixes[order[k - 1]][0], suffixes[order[k]][0]) for k in range(1, len(order))]
    out = [0] * len(suffixes)
    for depth in range(window, prefix - 1, -1):
        left = window - depth
        k = 0
        while k < len(order):
            end = k + 1
            while end < len(order) and shared[end] >= depth:
                end += 1
            if end - k > 1:  # an inner node at least this deep, with its leaves
                first: dict[bytes, tuple] = {}
                own = []
                for i in order[k:end]:
                    right, before, place = suffixes[i]
                    if len(right) >= depth and len(before) >= left:
                        key = b" ".join(before[len(before) - left :])
                        own.append((i, key, place))
                        if key not in first or place < first[key]:
                            first[key] = place
                for i, key, place in own:
                    if first[key] < place:
                        out[i] |= 1 << left
            k = end
    return out


def _valid(right: F.Column, before: F.Column, window: int, prefix: int) -> F.Column:
    """The offsets whose windows lie within the document, as bits: at least window - right, at most before."""
    low, high = F.greatest(F.lit(0), window - right), F.least(before, F.lit(window - prefix))
    return F.when(high >= low, F.expr("CAST(1 AS BIGINT)") * (F.pow(F.lit(2), high + 1).cast("long") - F.pow(F.lit(2), low).cast("long"))).otherwise(F.lit(0).cast("long"))


def _anchor_rows(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """prefix (hash), doc, version (hash of the text) and at, for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(words_of(x), window, prefix) for x in batch.column(2).to_pylist()]
            count = [len(a) for a, _ in found]
            repeat = lambda k: pa.array(np.repeat(batch.column(k).to_numpy(), count))  # noqa: E731, B023
            if sum(count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p for _, p in found]).view(np.int64)), repeat(0), repeat(1), pa.array(np.concatenate([a for a, _ in found]).astype(np.int32))],
                    names=["prefix", "doc", "version", "at"],
                )

    return docs.mapInArrow(run, "prefix long, doc long, version long, at int")


def _suffix_rows(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """prefix, doc, version, at, and the words right and left of each anchor in the column places (array of at and prefix)."""
    reach = window - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            docs, versions, texts, places = (batch.column(k).to_pylist() for k in range(4))
            for doc, version, text, own in zip(docs, versions, texts, places):
                words = words_of(text)
                for x in own:
                    i = x["at"]
                    rows.append((x["prefix"], doc, version, i, b" ".join(words[i : i + window]), b" ".join(words[max(0, i - reach) : i]), min(window, len(words) - i), min(i, reach)))
            for k in range(0, len(rows), 20_000):
                columns = list(zip(*rows[k : k + 20_000]))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["prefix", "doc", "version", "at", "right_words", "left_words", "n_right", "n_left"])

    return texts.mapInArrow(run, "prefix long, doc long, version long, at int, right_words binary, left_words binary, n_right int, n_left int")


def _subtrees(suffixes: DataFrame, window: int, prefix: int) -> DataFrame:
    """prefix, suffix (hash) and gone (bits) of the suffixes that repeat an earlier place; rows are sorted by prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            gone = subtree([(r[2].split(), r[3].split(), (r[4], r[5])) for r in group], window, prefix)
            out.extend((r[0], r[1], g) for r, g in zip(group, gone) if g)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        close()
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["prefix", "suffix", "gone"])
                out = []
        if len(group) > 1:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["prefix", "suffix", "gone"])

    rows = suffixes.select("prefix", "suffix", "right_words", "left_words", "doc", "at").repartition("prefix").sortWithinPartitions("prefix")
    return rows.mapInArrow(run, "prefix long, suffix long, gone long")


def _long_prefixes(suffixes: DataFrame, window: int, prefix: int) -> DataFrame:
    """As _subtrees, for prefixes with many suffixes: the prefix is a whole window and its first place an aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, s, right, left, doc, at in zip(*(c.to_pylist() for c in batch.columns)):
                right, left = right.split(), left.split()
                for o in range(max(0, window - len(right)), min(len(left), window - prefix) + 1):
                    rows.append((p, s, doc, at - o, o, b" ".join(left[len(left) - o :] + right[: window - o])))
            for k in range(0, len(rows), 20_000):
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000]), types)], names=["prefix", "suffix", "doc", "start", "o", "words"])

    rows = suffixes.select("prefix", "suffix", "right_words", "left_words", "doc", "at").mapInArrow(run, "prefix long, suffix long, doc long, start int, o int, words binary")
    # both stored, so that the join of a hot window can be split
    rows = common.stored(rows.select("prefix", "suffix", "doc", "start", "o", F.sha2("words", 256).alias("words")), "long-rows")
    first = common.stored(rows.groupBy("words").agg(F.min(_place("doc", "start")).alias("first")), "long-firsts")
    later = rows.join(first, "words").where(_place("doc", "start") > F.col("first"))
    return later.groupBy("prefix", "suffix").agg(F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), o))").alias("gone"))


def _place(doc: str, at: str) -> F.Column:
    """Document and start as one number that orders like the two."""
    return F.col(doc).cast("decimal(20,0)").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(at).cast("decimal(11,0)")


def removed(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc, version and cuts (array of at and gone): for each anchor, the windows about it that go. docs has doc, version, text."""
    found = common.stored(_anchor_rows(docs, window, prefix), "anchors")
    # stored, so that both sides of the join come straight from a shuffle and Spark can split a hot prefix's
    repeated = common.stored(found.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "repeated")
    # stored, so that what was shuffled for it is gone before the texts are
    places = common.stored(found.join(repeated, "prefix", "left_semi").groupBy("doc", "version").agg(F.collect_set(F.struct("at", "prefix")).alias("places")), "places")
    common.forget(found)
    common.forget(repeated)
    suffixes = common.stored(
        _suffix_rows(docs.join(places, ["doc", "version"]).select("doc", "version", "text", "places"), window, prefix).withColumn("suffix", F.xxhash64("right_words", "left_words")),
        "suffixes",
    )
    common.forget(places)
    first = suffixes.groupBy("prefix", "suffix", "right_words", "left_words").agg(F.min(_place("doc", "at")).alias("first"))
    base = F.lit(1 << 32).cast("decimal(11,0)")
    # a place is doc * 2^32 + at with 0 <= at < 2^31, so both come back from it
    distinct = common.stored(
        first.withColumn("doc", F.floor(F.col("first") / base).cast("long")).withColumn("at", (F.col("first") - F.col("doc").cast("decimal(20,0)").cast("decimal(38,0)") * base).cast("int")).drop("first"),
        "distinct",
    )
    sizes = distinct.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    sized = distinct.join(sizes, "prefix")
    gone = _subtrees(sized.where(F.col("n") <= group), window, prefix).unionByName(_long_prefixes(sized.where(F.col("n") > group), window, prefix))
    gone = common.stored(gone, "gone")
    firsts = distinct.select("prefix", "suffix", F.col("doc").alias("first_doc"), F.col("at").alias("first_at")).join(gone, ["prefix", "suffix"], "left")
    # stored, so that a hot suffix's join can be split
    firsts = common.stored(firsts, "firsts")
    here = (F.col("doc") == F.col("first_doc")) & (F.col("at") == F.col("first_at"))
    cut = F.when(here, F.coalesce("gone", F.lit(0).cast("long"))).otherwise(_valid(F.col("n_right"), F.col("n_left"), window, prefix))
    cuts = suffixes.select("prefix", "suffix", "doc", "version", "at", "n_right", "n_left").join(firsts, ["prefix", "suffix"]).select("doc", "version", "at", cut.alias("gone")).where("gone <> 0")
    cuts = common.stored(cuts.groupBy("doc", "version").agg(F.collect_set(F.struct("at", "gone")).alias("cuts")), "cuts")
    for df in (suffixes, distinct, gone, firsts):
        common.forget(df)
    return cuts


def kept_words(text: str | None, cuts: list[dict] | None, window: int = WINDOW) -> tuple[list[bytes], list[bytes]]:
    """All words of a text, and those that stay."""
    words = words_of(text)
    if not cuts:
        return words, words
    mark = [0] * (len(words) + 1)
    for x in cuts:
        bits, o = x["gone"], 0
        while bits:
            if bits & 1:
                mark[x["at"] - o] += 1
                mark[x["at"] - o + window] -= 1
            bits, o = bits >> 1, o + 1
    covered = np.cumsum(mark[:-1]).tolist()
    return words, [w for w, c in zip(words, covered) if not c]


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space, as bytes) of each row of docs (doc_id, text)."""
    common.ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_DOC)).alias("doc"), F.xxhash64("text").alias("version"), F.encode("text", "UTF-8").alias("text"), "doc_id")
    cuts = removed(texts.select("doc", "version", "text"), window, prefix, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_words(t, c, window) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(a) for a, _ in found], pa.int64()),
                    pa.array([len(a) - len(b) for a, b in found], pa.int64()),
                    pa.array([b" ".join(b) for _, b in found], pa.binary()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = texts.join(cuts, ["doc", "version"], "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start earlier."""
    found = dedup(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS h FROM s),
f AS (SELECT h, min({'d': doc_id, 'i': i}) AS first FROM g GROUP BY h HAVING count(*) > 1),
l AS (SELECT doc_id, i FROM g JOIN f ON g.h = f.h WHERE {'d': doc_id, 'i': i} > first),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l),
k AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
r AS (SELECT k.doc_id, count(c.p) AS n, string_agg(word, ' ' ORDER BY k.p) FILTER (c.p IS NULL) AS kept FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
