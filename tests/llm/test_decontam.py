import random
import re

from helixloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            v = words(it)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit |= set(range(s, s + len(part)))
                        found.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), decontam.digest(list(found)), bool(hit)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) + rng.choice(["", "É", "9", "-x"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]), 8)) for i in range(25)] + [(100, None), (101, ""), (102, "--"), (None, "null item words"), (7, "again 7")]
    docs = [(i, text(rng.randrange(0, 80), 8)) for i in range(40)] + [(50, None), (51, ""), (51, "")]
    for i in range(60, 90):
        w = words(rng.choice(items)[1] or "")
        docs.append((i, text(5, 8) + "; " + "  ".join(w).upper() + "! " + text(4, 8)))
    return docs, items


def test_hits_equal_brute_force(spark, monkeypatch):
    for seed, bits in ((1, decontam.MAP_BITS), (2, 1 << 15)):  # the small map lets most places through
        monkeypatch.setattr(decontam, "MAP_BITS", bits)
        docs, items = made(seed)
        d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = decontam.hits(d, b).collect()
        assert sorted([(r.doc_id, r.n_words, len(r.hit_words), len(r.hit_items), decontam.digest(r.hit_items), bool(r.hit_words)) for r in got], key=str) == plain(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontam.hits(d.limit(0), b).count() == 0
    assert decontam.hits(d, b.limit(0)).first().hit_words == []
    assert decontam.hits(d, b).first().hit_items == ["1"]


def test_long_texts(spark):
    """A text of a megabyte with a benchmark window at its end, and an item of as many words."""
    item = " ".join(f"item{i}" for i in range(40))
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    d = spark.createDataFrame([(1, long + " " + item), (2, long), (3, "w1 w2")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, long[:300_000])], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.hits(d, b).collect()}
    assert got[1].hit_items == ["1", "2"] and got[2].hit_items == ["2"] and got[3].hit_items == []
    assert len(got[1].hit_words) - len(got[2].hit_words) >= 40 and len(got[2].hit_words) > 190_000
