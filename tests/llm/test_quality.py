import re

from helixloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a a", "a b c a b c x a b", "é#*é\n\nx\nx\n y\n y\r\nx\n", "the cat\x0bsat " * 40, "\x1cx\x85y\xa0z", " lead #<>|", "w " * 3000]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measured(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), repr(t)


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "", "fine") for i in range(200)] + [(i, "", "bad") for i in range(200, 260)] + [(300, good, "bad"), (301, "", "small"), (302, good, "small"), (303, good, None), (303, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.kept) for r in quality.judge(docs).collect()}
    assert (300, False) in got and (303, True) in got and (1, True) in got and (0, False) in got
    assert len(got) == 264 and quality.judge(docs.limit(0)).count() == 0
