"""Local assembly of reads into contigs: greedy walks over words of bases, and the refinement of breakends.

A locus has at most MAX_READS reads, so each locus is assembled by one call; loci are spread over tasks.
"""

from __future__ import annotations

from zlib import crc32

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align as A

MAX_READS, MAX_CONTIGS = 1000, 10


@dataclass(frozen=True)
class Options:
    min_word: int = 41
    max_word: int = 76
    step: int = 5
    min_coverage: int = 1
    min_seed_reads: int = 3
    min_contig: int = 15
    max_rounds: int = 10


@dataclass
class Contig:
    seq: str
    support: set[int] = field(default_factory=set)
    reject: set[int] = field(default_factory=set)
    seed_reads: int = 0


def word_reads(reads: list[str], k: int) -> dict[str, set[int]]:
    """For each word of k bases without N, the reads that have it."""
    out: dict[str, set[int]] = {}
    for n, r in enumerate(reads):
        for i in range(len(r) - k + 1):
            w = r[i : i + k]
            if "N" not in w:
                out.setdefault(w, set()).add(n)
    return out


def repeat_words(words, longest: int = 50) -> set[str]:
    """Words on cycles of the word graph, of at most `longest` words; homopolymers are cycles of one."""
    follow = {w: [w[1:] + b for b in "ACGT" if w[1:] + b in words] for w in words}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, out = set(), [], set()
    for root in sorted(words):
        if root in index:
            continue
        todo = [(root, iter(follow[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while todo:
            w, rest = todo[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = len(index)
                    stack.append(x)
                    on.add(x)
                    todo.append((x, iter(follow[x])))
                    break
                if x in on:
                    low[w] = min(low[w], index[x])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[w])
                if low[w] == index[w]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == w:
                            break
                    if (len(part) > 1 and len(part) <= longest) or w in follow[w]:
                        out.update(part)
    return out


def walk(seed: str, words: dict[str, set[int]], options: Options, repeats=frozenset()) -> tuple[Contig, set[str], bool]:
    """The contig that grows from a seed word to the right, then to the left, the words it used and whether it ran into a repeat.

    The next base is the one whose word shares most reads with the contig; reads of other branches are rejected.
    """
    k = len(seed)
    contig, used = Contig(seed, set(words[seed]), set(), len(words[seed])), {seed}
    if seed in repeats:
        return contig, used, True
    for b in "ACGT":
        if b != seed[-1]:
            contig.reject |= words.get(seed[:-1] + b, set())
    looped = False
    for right in (True, False):
        while True:
            trunk = contig.seq[-(k - 1) :] if right else contig.seq[: k - 1]
            options_here = [(b, words[w]) for b in "ACGT" if (w := trunk + b if right else b + trunk) in words]
            shared = [(len(contig.support & r), -"ACGT".index(b), b, r) for b, r in options_here if contig.support & r]
            if not shared:
                break
            _, _, base, chosen = max(shared, key=lambda x: x[:2])
            if len(chosen) < options.min_coverage:
                break
            word = trunk + base if right else base + trunk
            if word in used:
                looped = True
                break
            own = contig.support & chosen
            for b, r in options_here:
                if b != base:
                    contig.reject |= r - own
                    contig.support -= r - own
            # words that end in the new word's trunk but begin otherwise are other branches as well
            for b in "ACGT":
                back = (b + word[1:]) if right else (word[:-1] + b)
                if back != word and back in words:
                    contig.reject |= words[back] - own
                    contig.support -= words[back] - own
            contig.seq = contig.seq + base if right else base + contig.seq
            contig.support |= chosen - contig.reject
            used.add(word)
    return contig, used, looped


def contigs_of_word(reads: list[str], k: int, options: Options) -> tuple[list[Contig], bool]:
    """Contigs from all seeds in order of how many reads they have, and whether a walk met a repeat."""
    words = word_reads(reads, k)
    repeats = repeat_words(words)
    unused, out, looped = set(words), [], False
    while unused and len(out) < MAX_CONTIGS * 5:
        seed = max(unused, key=lambda w: (len(words[w]), w))
        if len(words[seed]) < options.min_coverage:
            break
        contig, used, loop = walk(seed, words, options, repeats)
        looped |= loop
        unused -= used
        out.append(contig)
    return out, looped


def iterative(reads: list[str], options: Options = Options()) -> list[Contig]:
    """Contigs by growing words: contigs of one word length are reads of the next, until no repeat is met.

    The contigs with most new supporting reads are chosen, longer ones first among equals.
    """
    reads = reads[:MAX_READS]
    extra: list[str] = []
    found: list[Contig] = []
    for k in range(options.min_word, options.max_word + 1, options.step):
        if not any(len(r) >= k for r in reads):
            break
        pseudo = [c for c in extra for _ in range(max(options.min_coverage, options.min_seed_reads))]
        found, looped = contigs_of_word(reads + pseudo, k, options)
        if not looped:
            break
        extra = [c.seq for c in found if len(c.seq) >= k]
    return chosen(found, len(reads), options)


def chosen(found: list[Contig], n_reads: int, options: Options) -> list[Contig]:
    covered: set[int] = set()
    rest = [Contig(c.seq, {x for x in c.support if x < n_reads}, {x for x in c.reject if x < n_reads}, c.seed_reads) for c in found if len(c.seq) >= options.min_contig]
    out: list[Contig] = []
    while rest and len(out) < MAX_CONTIGS:
        best = max(rest, key=lambda c: (len(c.support - covered), len(c.seq), c.seq))
        if len(best.support - covered) < options.min_seed_reads:
            break
        out.append(best)
        covered |= best.support
        rest.remove(best)
    return out


def small(reads: list[str], options: Options = Options()) -> list[Contig]:
    """Contigs one at a time: each round takes the shortest word without repeats, and its reads leave."""
    left = dict(enumerate(reads[:MAX_READS]))
    out: list[Contig] = []
    for _ in range(options.max_rounds):
        if len(left) < options.min_seed_reads:
            break
        ids = list(left)
        own = [left[i] for i in ids]
        best = None
        for k in range(options.min_word, options.max_word + 1, options.step):
            words = word_reads(own, k)
            if not words:
                break
            repeats = repeat_words(words)
            seed = max(words, key=lambda w: (len(words[w]), w))
            if len(words[seed]) < options.min_seed_reads:
                break
            contig, _, looped = walk(seed, words, options, repeats)
            best = contig
            if not looped:
                break
        if best is None or not best.support:
            break
        support = {ids[x] for x in best.support}
        out.append(Contig(best.seq, support, {ids[x] for x in best.reject}, best.seed_reads))
        for i in support:
            left.pop(i, None)
    return out


def assembled(reads: DataFrame, keys=("locus", "n1", "n2"), seq: str = "seq", options: Options = Options(), method=iterative) -> DataFrame:
    """contig, n_support, n_reject and bases of each group's contigs. Of a group with more than MAX_READS reads those with the least hashes are used, a fixed choice that favours no base or place."""
    types = [reads.schema[k].dataType.simpleString() for k in keys]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(sorted(pdf[seq].dropna().tolist(), key=lambda x: (crc32(x.encode()), x))[:MAX_READS])
        rows = [(*key, n, len(c.support), len(c.reject), c.seq) for n, c in enumerate(method(own, options))]
        return pd.DataFrame(rows, columns=[*keys, "contig", "n_support", "n_reject", "bases"])

    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, types)), "contig int, n_support int, n_reject int, bases string"])
    return reads.groupBy(*keys).applyInPandas(run, schema)


def usable_reads(reads: DataFrame, min_indel: int = 4, min_semi_aligned: int = 4) -> DataFrame:
    """Reads that help an assembly: with indels, poorly aligned edges (columns of observations.with_edges) or unmapped beside an anchor."""
    indel = F.exists("path", lambda s: s["op"].isin("I", "D") & (s["len"] >= min_indel))
    edge = F.greatest("lead_n", "trail_n") >= min_semi_aligned if "lead_n" in reads.columns else F.lit(False)
    return reads.where(indel | edge | F.col("is_unmapped"))


def extended(contig: str, lead: str, trail: str) -> str:
    return lead + contig + trail


def microhomology(ref: str, begin: int, end: int, inserted: str = "") -> tuple[int, int]:
    """How far the variant ref[begin:end] -> inserted can move to the left and to the right with the same result."""
    gone = ref[begin:end]
    text = gone or inserted
    if not text or (gone and inserted):
        return 0, 0
    left = right = 0
    n = len(text)
    while begin - left - 1 >= 0 and ref[begin - left - 1] == text[(-left - 1) % n]:
        left += 1
    while end + right < len(ref) and ref[end + right] == text[right % n]:
        right += 1
    return left, right


def masked_range(query: str, ref: str, k: int = 10) -> tuple[int, int]:
    """The part of ref that shares words of k bases with the query: bounds for an alignment."""
    words = {query[i : i + k] for i in range(len(query) - k + 1)}
    hits = [i for i in range(len(ref) - k + 1) if ref[i : i + k] in words]
    return (hits[0], hits[-1] + k) if hits else (0, len(ref))


def refined_indels(contig: str, ref: str, offset: int, least: int = 8, sc: A.Scores = A.Scores(), large: int = -100) -> list[dict]:
    """Indels of at least `least` bases in a contig's alignment: place, bases gone, bases inserted, homology."""
    lo, hi = masked_range(contig, ref)
    lo, hi = max(0, lo - len(contig)), min(len(ref), hi + len(contig))
    score, start, cigar = A.align(contig, ref[lo:hi], sc, large)
    out, q, r = [], 0, lo + start
    parts = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    k = 0
    while k < len(parts):
        n, op = parts[k]
        if op in "ID":
            gone = ins = 0
            while k < len(parts) and parts[k][1] in "ID":
                gone += parts[k][0] if parts[k][1] == "D" else 0
                ins += parts[k][0] if parts[k][1] == "I" else 0
                k += 1
            bases = contig[q : q + ins]
            if max(gone, ins) >= least:
                left, right = microhomology(ref, r, r + gone, bases)
                out.append({"pos": offset + r - left, "deleted": gone, "inserted": bases, "homology": left + right, "score": score, "cigar": cigar})
            q, r = q + ins, r + gone
            continue
        q += n if op in "MS=X" else 0
        r += n if op in "M=XN" else 0
        k += 1
    return out


def best_contig(contigs: list[str], ref: str, least: int = 8) -> tuple[int, list[dict]] | None:
    """The contig whose indels have the best alignment score for its length, with them."""
    best = None
    for n, c in enumerate(contigs):
        found = refined_indels(c, ref, 0, least)
        if found and (best is None or found[0]["score"] > best[1][0]["score"]):
            best = (n, found)
    return best


def refined_jump(contig: str, ref1: str, offset1: int, ref2: str, offset2: int, sc: A.Scores = A.Scores(), jump: int = -25) -> dict | None:
    """Breakends of a contig that jumps from one region to another: exact places, inserted bases; None if it does not."""
    r = A.jump_align(contig, ref1, ref2, sc, jump)
    if not r["cigar1"] or not r["cigar2"]:
        return None
    span = lambda c: sum(int(n) for n, op in re.findall(r"(\d+)([MIDN=X])", c) if op in "MDN=X")
    return {"bp1": offset1 + r["start1"] + span(r["cigar1"]), "bp2": offset2 + r["start2"], "inserted": contig[r["jump_at"] : r["jump_at"] + r["jump_insert"]], **r}


def paired_inserts(left: list[tuple[int, str]], right: list[tuple[int, str]], near: int = 35) -> list[tuple[int, str, str]]:
    """Half contigs of a large insertion, (place, inserted bases), that lie within `near` of each other."""
    out, used = [], set()
    for p, a in sorted(left):
        close = [(abs(p - q), k) for k, (q, _) in enumerate(right) if abs(p - q) <= near and k not in used]
        if close:
            _, k = min(close)
            used.add(k)
            out.append((min(p, right[k][0]), a, right[k][1]))
    return out


def refine(assembled_: DataFrame, reference: DataFrame, keys=("locus", "n1", "n2"), least: int = 8) -> DataFrame:
    """Indels of the contigs (of assembled) against the reference piece of each group (keys, offset, bases as ref)."""

    @F.pandas_udf("array<struct<pos:int,deleted:int,inserted:string,homology:int,score:int,cigar:string>>")
    def found(bases: pd.Series, ref: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([refined_indels(b, r, int(o), least) for b, r, o in zip(bases, ref, offset)])

    joined = assembled_.join(reference, list(keys))
    return joined.select(*keys, "contig", "n_support", F.explode(found("bases", "ref", "offset")).alias("_v")).select(*keys, "contig", "n_support", "_v.*")


def mean_quality(qual) -> float:
    return float(np.mean(qual)) if len(qual) else 0.0
