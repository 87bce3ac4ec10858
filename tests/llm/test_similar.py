import random

from helixloom.llm import similar


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def planted(seed):
    """Texts with copies at similarities about 0.8, a common passage and a large group of near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = ["", None, " ", "one two", "One two", "one three"]
    for n in (30, 60, 100, 150, 200) * 6:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in range(rng.randrange(7)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]) for _ in range(30)]
    base = [word() for _ in range(120)]
    texts += [" ".join(base[:k] + [word()] + base[k:]) for k in range(0, 120, 3)]
    rng.shuffle(texts)
    return texts


def test_components_against_brute_force(spark):
    """No false link ever; of the true ones, those that a fingerprint can miss are few."""
    linked = total = 0
    for seed, options in ((1, {}), (2, {"cell": 7})):
        texts = planted(seed)
        expected = plain_components(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.root for r in similar.near_duplicates(docs, **options).collect()}
        assert sorted(got) == list(range(len(texts)))
        wanted = {}
        for i, r in enumerate(expected):
            wanted.setdefault(got[i], set()).add(r)
            total += expected[i] != i
            linked += expected[i] != i and got[i] == got[expected[i]]
        assert all(len(x) == 1 for x in wanted.values())
        assert 40 < len(wanted) < len(texts) - 60
    assert linked >= 0.97 * total, (linked, total)


def test_grid_follows_the_number_of_nodes():
    small, large = similar.Grid(1000), similar.Grid(1 << 32)
    assert small.axes == similar.AXES and large.axes > small.axes and large.grids > small.grids


def test_prints_tell_similarity():
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    near = base[:150] + ["new"] + base[151:]
    far = [f"v{rng.randrange(9000)}" for _ in range(300)]
    a, b, c = (similar.print_of(similar.shingles(" ".join(x))) for x in (base, near, far))
    unlike = lambda x, y: int(sum(int(v).bit_count() for v in x ^ y))
    assert unlike(a, b) < 120 and unlike(a, c) > 400
    bound = sum(int(similar.manhattan(similar.embedded(x[i : i + 1]), similar.embedded(y[i : i + 1]))[0]) for x, y in ((a, b),) for i in range(similar.WORDS))
    assert bound <= unlike(a, b)


def test_the_stage_drops_copies_far_apart_in_fingerprint_bits(spark):
    import corpus_pipeline

    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(100)]
    rows = [(i, " ".join(base[:k] + ["new"] + base[k:]), "x") for i, k in enumerate(range(5, 95, 10))] + [(20, " ".join(f"v{i}" for i in range(90)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 20]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
