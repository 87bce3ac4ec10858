import random
from collections import Counter

from helixloom.llm import shards


def test_differencing_is_tight_and_whole():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 10_000) for _ in range(3000)]
    parts = shards.difference(sizes, 16)
    sums = [sum(s for s, p in zip(sizes, parts) if p == k) for k in range(16)]
    assert max(sums) - min(sums) <= 16
    assert shards.difference([], 4) == [] and shards.difference([5], 4) == [0]

    two = shards.difference([8, 7, 6, 5, 4], 2)
    assert abs(sum(s if p else -s for s, p in zip([8, 7, 6, 5, 4], two))) == 2


def test_rows_groups_and_slots(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["same text", None, "", "x" * rng.randrange(1, 300)])) for i in range(500)] + [(1, "dup"), (1, "dup")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, shard int")
    for chunks in (shards.CHUNKS, 20):
        got = shards.assign(docs, chunks=chunks).collect()
        assert len(got) == len(rows)
        per = Counter(r.shard for r in got)
        for k, n in per.items():
            assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
        assert len({r.shard for r in got if r.text_crc32 == __import__("zlib").crc32(b"same text")}) == 1
    assert shards.assign(docs.limit(0)).count() == 0


def plain_difference(sizes, parts):
    """Differencing as it is told: lists of sums with their items, the two widest combined again and again."""
    rows = [(i, [(s, [i])] + [(0, [])] * (parts - 1)) for i, s in enumerate(sizes)]
    ticket = len(rows)
    while len(rows) > 1:
        rows.sort(key=lambda r: (-(r[1][0][0] - r[1][-1][0]), r[0]))
        (_, a), (_, b) = rows[:2]
        both = sorted([(x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b))], key=lambda x: -x[0])
        rows = [*rows[2:], (ticket, both)]
        ticket += 1
    return sorted(sum(sizes[i] for i in items) for _, items in rows[0][1])


def test_differencing_equals_a_plain_version():
    rng = random.Random(9)
    for n, parts in ((7, 3), (40, 4), (120, 16), (3, 5)):
        sizes = [rng.randrange(1, 1000) for _ in range(n)]
        own = shards.difference(sizes, parts)
        assert sorted(sum(s for s, p in zip(sizes, own) if p == k) for k in range(parts)) == plain_difference(sizes, parts)


def test_query_against_a_plain_version(spark, tmp_path):
    """Every column of the query, from the rows alone; the shards' sums are those of plain differencing of groups."""
    import zlib

    rng = random.Random(8)
    texts = [None, "", "é" * 7, *("x" * rng.randrange(1, 3000) + str(i) for i in range(120))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, rng.choice(texts)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in shards.op6_shards(spark, str(tmp_path)).collect()}
    assert got.keys() == {i for i, _ in rows}
    groups = Counter()
    for i, t in rows:
        data = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        groups[t] += len(data) + 1
    assert all(len({got[i].shard for i, t in rows if t == g}) == 1 for g in groups)
    sums, counts = Counter(), Counter()
    for r in got.values():
        sums[r.shard] += r["size"]
        counts[r.shard] += 1
    # 123 groups, none so small that two share a chunk by more than chance; chunks only join groups, so sums stay near the plain ones
    plain = plain_difference(sorted(groups.values(), reverse=True), 16)
    assert sum(plain) == sum(sums.values()) and max(sums.values()) <= max(plain) + max(1, sum(plain) // 200)
    assert all(sorted(r.slot for r in got.values() if r.shard == k) == list(range(n)) for k, n in counts.items())
