from helixloom.llm import urls


def test_names_split_by_counts():
    counts = {"cheap": 50, "pills": 40, "the": 900, "a": 300, "pill": 5, "s": 10}
    assert urls.split_name("cheappills", counts, 2000) == ["cheap", "pills"]
    assert urls.split_name("thepills", counts, 2000) == ["the", "pills"]
    assert urls.split_name("", counts, 2000) == []
    assert "".join(urls.split_name("zzqqzz" * 20, counts, 0)) == "zzqqzz" * 20


def test_rules_and_model(spark):
    known = [
        ("HTTP://A.Com/en/x?q", "a.com", "/en/x", "com/", "allow"),
        ("https://blog.Example.com/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
        ("https://m.www.example.com/en/1#t", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://x.net/es/9", "x.net", "/es/9", "net/es/", "block"),
        ("http://x.com", "x.com", "", None, None),
        ("http://notexamplecom/es/", "notexamplecom", "/es/", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("x://?a/b", "", "", None, None),
    ]
    rows = [(i, u, "<p>cheap pills the</p>" if i else None, "x") for i, (u, *_) in enumerate(known)] + [(3, "http://x.net/es/9", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(known):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.judge(pages).count() == len(rows)
    assert urls.judge(pages.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    bad, good = ["cheap-pills", "casinowin", "freebets"], ["library", "gardening", "oldschool"]
    rows = [(i, f"http://{(bad if i % 2 else good)[i // 2 % 3]}{i}.example.{'bad' if i % 2 else 'good'}/a/{i}", "cheap pills casino win free bets library gardening old school") for i in range(120)]
    rows += [(1000 + i, f"http://{n}.example.org/a/{i}", "") for i, n in enumerate(bad + good)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules=(("bad/", "block"), ("good/", "allow"))).collect()}
    assert [got[1000 + i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


def plain_judge(rows, rules):
    """The same model over lists: word counts of all html, Viterbi over them, naive Bayes fitted on what rules decide."""
    import math
    import re
    from collections import Counter

    def parts(url):
        _, mark, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if mark else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if mark else ""
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    def ruled(host, path):
        fits = [(len(r), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[1:] if fits else (None, None)

    counts = Counter()
    for _, _, html in rows:
        text = re.sub(r"<[^>]*>", " ", html or "").lower()
        counts.update(w for w in re.split("[^a-z0-9]+", text) if 1 <= len(w) <= urls.LONGEST)
    total = sum(counts.values())

    def best(name):
        """The likeliest of all ways to split a name, by trying each first word."""
        table = {len(name): (0.0, [])}
        for start in reversed(range(len(name))):
            options = []
            for end in range(start + 1, min(len(name), start + urls.LONGEST) + 1):
                n = counts.get(name[start:end], 0)
                p = math.log(n / total) if n else math.log(10 / max(total, 10)) - (end - start) * math.log(10)
                options.append((p + table[end][0], [name[start:end], *table[end][1]]))
            table[start] = max(options, key=lambda x: x[0])
        return table[0]

    def tokens(host, path):
        own = ["host " + w for name in re.split("[^a-z0-9]+", host) if name for w in best(name)[1]]
        return own + ["path " + ("0" if re.fullmatch("[0-9]+", t) else t) for t in re.split("[^a-z0-9]+", path.lower()) if t]

    seen = {"block": Counter(), "allow": Counter()}
    pages = Counter()
    for _, url, _ in rows:
        host, path = parts(url)
        if (v := ruled(host, path)[1]) is not None:
            seen[v].update(tokens(host, path))
            pages[v] += 1
    words = set(seen["block"]) | set(seen["allow"])
    size = {v: sum(seen[v].values()) + len(words) for v in seen}
    odds = {w: math.log((seen["block"][w] + 1) / size["block"]) - math.log((seen["allow"][w] + 1) / size["allow"]) for w in words}
    out = {}
    for page, url, _ in rows:
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        score = math.log(pages["block"] / pages["allow"]) + sum(odds.get(t, 0.0) for t in tokens(host, path))
        out[page] = (host, path, rule, verdict or ("block" if score > 0 else "allow"), None if verdict else score)
    return out


def test_model_equals_a_plain_version(spark):
    import random

    rng = random.Random(7)
    words = ["cheap", "pills", "news", "garden", "win", "casino", "library", "old", "the", "a", "shop"]
    rows = []
    for i in range(300):
        host = "".join(rng.choices(words, k=rng.randrange(1, 4))) + rng.choice(["", "1", "-x"]) + rng.choice([".com", ".net", ".org", ".example.com"])
        path = rng.choice(["", "/", "/es/", "/fr/", "/en/"]) + "/".join(rng.choices([*words, "12", "7a"], k=rng.randrange(3)))
        rows.append((i, rng.choice(["http://", "HTTPS://"]) + host.title() + ("/" + path.lstrip("/") if path else "") + rng.choice(["", "?q=1", "#t"]), "<b>" + " ".join(rng.choices(words, k=13)) + "</b>"))
    rows += [(900, None, None), (901, "no scheme", ""), (902, "http://" + "casinowinshop" * 400 + ".org/a", "")]
    expected = plain_judge(rows, urls.RULES)
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.keys() == expected.keys()
    for page, (host, path, rule, verdict, score) in expected.items():
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule), page
        if score is None or abs(score) > 1e-6:
            assert r.verdict == verdict, page
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-4), page
