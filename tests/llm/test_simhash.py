import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from helixloom.llm import simhash


def plain_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted(seed, n):
    rng = random.Random(seed)
    fps = []
    for _ in range(n):
        f = rng.getrandbits(64)
        fps.append(f)
        for _ in range(rng.choice([0, 0, 1, 6])):
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                f ^= 1 << b
            fps.append(f)
    rng.shuffle(fps)
    return fps


def test_fingerprints_equal_the_rule():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 60, 9000):
        t = " ".join(rng.choice(["The", "ÉTÉ", "cat", "a\tb", "x"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_links_connect_all_and_only_near_fingerprints(spark):
    for cell in (simhash.CELL, 3):
        fps = planted(7, 60) + [0b11 << i for i in range(30)] + [1 << i for i in range(40)]
        signed = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
        nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
        found = simhash.components(simhash.links(nodes, cell=cell)).collect()
        roots = {r.node: r.root for r in found}
        unsigned = [f & (1 << 64) - 1 for f in signed]
        expected = plain_components(unsigned)
        assert [roots.get(f, f) for f in signed] == [signed[i] for i in expected]


def test_cells_are_not_broadcast(spark):
    fps = np.array(planted(5, 40), np.uint64).view(np.int64).tolist()
    nodes = spark.range(len(fps)).select(F.element_at(F.array(*map(F.lit, fps)), F.col("id").cast("int") + 1).alias("fp")).distinct()
    found = simhash.links(nodes)
    first = found._jdf.queryExecution().executedPlan().toString()
    assert found.collect()
    last = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in last and "BroadcastExchange" not in first + last and "SortMergeJoin" in last


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, None), (2, "   "), (7, None), (None, base), (11, "quite other words here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    near = (simhash.fingerprint(base) ^ simhash.fingerprint(base + " tail")).bit_count() <= 4
    assert got == {(5, 3), (3, 3), (9, 3 if near else 9), (7, 2), (2, 2), (None, 3), (11, 11)}
    assert simhash.near_duplicates(docs).count() == 8 and simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other words in this one"), (None, "alone here now then"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    got = sorted(map(str, [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]))
    assert got == sorted(map(str, [(3, "a b c d e f"), (3, "other words in this one"), (None, "alone here now then"), (None, None)]))
