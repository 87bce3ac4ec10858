import random

import pytest

from helixloom.llm import substrings


def plain(rows, window=20):
    docs = [(-(1 << 63) if i is None else i, substrings.words_of(t), i) for i, t in rows]
    first = {}
    for d, w, _ in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w, i in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), substrings.digest([x for k, x in enumerate(w) if k not in gone])))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n, k=400: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    passages = [text(n) for n in (19, 20, 21, 40, 60)]
    base = text(150)
    rows = [(i, text(rng.randrange(0, 120))) for i in range(20)]
    rows += [(i, base) for i in range(20, 26)]
    for i in range(26, 60):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 90):
        rows.append((i, text(rng.randrange(0, 9)) + "\n" + rng.choice(passages) + "\t " + text(rng.randrange(0, 9)) + " " + rng.choice(passages)))
    rows += [(90, "x " * 100), (91, "a b " * 50), (92, None), (93, ""), (93, ""), (94, base), (94, base), (None, base + " é"), (-5, text(30))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,group", [(1, substrings.GROUP), (2, 3), (3, 1)])
def test_dedup_equals_brute_force(spark, seed, group):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, doc int")
    got = [(r.doc_id, r.n_words, r.n_removed, substrings.digest(bytes(r.kept).split())) for r in substrings.dedup(docs, group=group).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(docs).count() == 0
