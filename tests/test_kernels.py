import random

import numpy as np
import pytest

from helixloom.functions import align as A
from helixloom.functions import assembly as S
from helixloom.functions import descriptor

SC = A.Scores(2, -4, -5, -1, -4)


@pytest.mark.parametrize(
    "query,ref,start,cigar",
    [("D", "ABCDEF", 3, "1="), ("BCDEFHIKLM", "ABCDEFGHIKLMN", 1, "5=1D5="), ("BCDEFGXHIKLM", "ABCDEFGHIKLMN", 1, "6=1I5="), ("BBBBBBCDXYZHIKLMMMM", "ABBBBBBCDEFGHIKLMMMMN", 1, "8=3I3D8=")],
)
def test_known_alignments(query, ref, start, cigar):
    score, at, found = A.align(query, ref, SC)
    assert (at, found) == (start, cigar)
    assert score == A.path_score(cigar, SC)


def brute(query, ref, sc):
    """Best score by plain recursion over cells."""
    bad, n, w = -10_000, len(query), len(ref)
    m = [[bad] * (w + 1) for _ in range(n + 1)]
    d, i_ = [r[:] for r in m], [r[:] for r in m]
    for j in range(w + 1):
        m[0][j] = 0
    for i in range(1, n + 1):
        m[i][0] = i * sc.off_edge
        for j in range(w + 1):
            if j:
                m[i][j] = max(m[i - 1][j - 1], d[i - 1][j - 1], i_[i - 1][j - 1]) + (sc.match if query[i - 1] == ref[j - 1] else sc.mismatch)
            if i > 1:
                i_[i][j] = max(m[i - 1][j] + sc.open, i_[i - 1][j]) + sc.extend
                if j:
                    d[i][j] = max(m[i][j - 1] + sc.open, d[i][j - 1], i_[i][j - 1]) + sc.extend
    return max([*m[n][1:], *(m[i][w] + (n - i) * sc.off_edge for i in range(n))])


def test_scores_equal_plain_recursion():
    rng = random.Random(1)
    for _ in range(150):
        ref = "".join(rng.choices("ACGT", k=rng.randrange(5, 40)))
        a = rng.randrange(len(ref))
        q = list(ref[a : a + rng.randrange(2, 30)]) or ["A"]
        for _ in range(rng.randrange(3)):
            q[rng.randrange(len(q))] = rng.choice(["", "A", "CC", "TTT"])
        q = "".join(q) or "A"
        score, start, cigar = A.align(q, ref, SC)
        assert score == brute(q, ref, SC), (q, ref)
        if not cigar.endswith("S") and "S" not in cigar:
            assert A.path_score(cigar, SC) == score


def test_empty_raises():
    with pytest.raises(ValueError):
        A.align("", "A")


def test_large_indel_and_jump():
    rng = random.Random(3)
    ref = "".join(rng.choices("ACGT", k=900))
    q = ref[100:160] + ref[500:560]
    _, start, cigar = A.align(q, ref, A.Scores(2, -8, -12, -1, -1), large=-30)
    assert start == 100 and "340D" in cigar
    a, b = ref[:400], "".join(rng.choices("ACGT", k=400))
    r = A.jump_align(a[200:260] + b[100:170], a, b, A.Scores(2, -8, -12, -1, -1), jump=-20)
    assert r["start1"] == 200 and r["start2"] - r["jump_at"] == 40 and r["jump_insert"] == 0 and r["score"] == 2 * 130 - 20


def test_split_reads():
    rng = random.Random(4)
    t = "".join(rng.choices("ACGT", k=300))
    r = A.split_read(t[100:200], [30] * 100, t, 150, 150)
    assert r["pos"] == 100 and r["evidence"] and r["mismatches"] == 0 and r["left"] + r["hom"] + r["right"] == 100
    assert not A.split_read(t[145:245], [30] * 100, t, 150, 150)["evidence"]


@pytest.mark.parametrize("method", [S.iterative, S.small])
def test_assembly_of_a_planted_sequence(method):
    rng = random.Random(5)
    source = "".join(rng.choices("ACGT", k=300))
    reads = [source[i : i + 100] for i in range(0, 201, 5)]
    found = method(reads)
    assert found and found[0].seq == source and len(found[0].support) == len(reads)
    assert method([]) == []


def test_refined_deletion_and_homology():
    rng = random.Random(6)
    ref = "".join(rng.choices("ACGT", k=600))
    v = S.refined_indels(ref[200:300] + ref[350:450], ref, 1000)
    assert len(v) == 1 and v[0]["deleted"] == 50 and v[0]["pos"] <= 1300 and v[0]["pos"] + v[0]["homology"] >= 1300
    assert S.microhomology("AACGCGCGTT", 2, 4) == (0, 4)
    assert S.repeat_words({"AAA"}) == {"AAA"} and S.repeat_words({"ACG", "CGT"}) == set()
    j = S.refined_jump(ref[100:160] + ref[400:460], ref[:300], 0, ref[300:], 300)
    assert (j["bp1"], j["bp2"]) == (160, 400)
    assert S.paired_inserts([(100, "AC")], [(120, "GT"), (500, "A")]) == [(100, "AC", "GT")]
    assert np.isclose(S.mean_quality([10, 20]), 15)


def test_reads_in_place():
    rng = random.Random(8)
    ref = "".join(rng.choices("ACGT", k=200))
    r = A.aligned_read(ref[50:150], [30] * 100, "100M", 50, ref, 0, 99, 100)
    assert (r["left"], r["hom"], r["right"], r["mismatches"], r["evidence"]) == (50, 0, 50, 0, True)
    assert not A.aligned_read(ref[50:150], [30] * 100, "100M", 50, ref, 0, 55, 56)["evidence"]


def test_match_descriptors():
    assert descriptor.to_cigar("10A5^AC$3^2$4") == "16M2D3M2I4M"
    assert descriptor.to_cigar("3^2$4", forward=False) == "4M2I3M"
    for bad in ("5Q", "^AC$5"):
        with pytest.raises(ValueError):
            descriptor.to_cigar(bad)
    ref, read = "ACGTACGTAC", "ACCTACTAC"
    md = descriptor.from_cigar("6M1D3M", 0, read, ref)
    assert md == "2G3^G$3" and descriptor.to_cigar(md) == "6M1D3M"
    assert descriptor.from_cigar("6M1D3M", 0, read, ref, forward=False) == "3^C$3C2"
