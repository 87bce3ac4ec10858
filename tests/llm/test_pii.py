import random
import re

from helixloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b", "@", "x.yz", ".", "4041894974608795", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4", "256.1.1.1", "007.0.0.1", " ", "-", "é", "\n", "+", "99", "@@", "..", "_", "(", "000000000000001.1.1.1"]
    for _ in range(4000):
        t = "".join(rng.choices(pieces, k=rng.randrange(0, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_checksums_context_and_masks():
    t = "IBAN GB82 WEST 1234 5698 7654 32, bad GB82 WEST 1234 5698 7654 33; card 3782 822463 10005; then a good deal of other text, so that nothing is near: call 555-123-4567, and then again far more text without any word that counts, the order 555-123-4567"
    found = pii.find(t)
    assert [t[a:b] for a, b in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [t[a:b] for a, b in found["short_card"]] == ["3782 822463 10005"]
    assert len(found["plain_phone"]) == 1
    assert pii.masked("mail é a@b.cd now") == "mail é [EMAIL] now"
    assert pii.masked(None) is None and pii.masked("") == ""
    assert pii.mod97("GB82WEST12345698765432") and not pii.luhn("1234567890123456")


def test_many_signs_stay_linear():
    pii.find("@" * 200_000 + "a" * 200_000 + "+1" * 50_000 + "1." * 50_000)


def plain_all(text):
    """All spans by plain loops: each proposal against each base span."""
    out = plain(text)
    taken = [x for k in pii.BASE for x in out[k]]
    out |= {k: [] for k in pii.ADDED}
    for kind, a, b, sure in pii._proposals(text):
        if not any(x < b and a < y for x, y in taken) and pii.score(text, kind, a, b, sure) >= pii.THRESHOLD - 1e-9:
            out[kind].append((a, b))
    return out


def test_query_equals_plain_spans(spark):
    import hashlib

    rng = random.Random(13)
    pieces = ["call 555-123-4567", "ssn 123-45-6789", "card 3782 822463 10005", "bank GB82 WEST 1234 5698 7654 32", "a@b.cd", "1.2.3.4", "+1 988 555 2485", "4041894974608795", " and ", "order ", "x" * 50, "é", ". ", "555-123-4567"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(0, 12)))) for i in range(300)]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        found = plain_all(t)
        assert got[i].spans == pii.written(found, pii.BASE + pii.ADDED), t
        assert got[i].base_sha256 == hashlib.sha256(pii.written(found, pii.BASE).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [len(found[k]) for k in pii.BASE]


def test_long_texts_take_their_length():
    import time

    for t in ("1" * 1_000_000 + ".", "a@b.cd 555-123-4567 " * 20_000, "1." * 300_000, "+1 (98) " * 100_000):
        at = time.process_time()
        pii.find(t)
        assert time.process_time() - at < 5


def test_query_shape(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "é a@b.cd 1.2.3.4", None)], "doc_id long, text string, n_email int")
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.spans) for r in pii.spans(docs).collect())
    assert got == [(1, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 1, "email:2:8,ip:9:16")]
    assert pii.spans(docs.limit(0)).count() == 0
    assert pii.mask(docs).where("doc_id = 3").first().text == "é [EMAIL] [IP]"
