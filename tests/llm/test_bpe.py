import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from helixloom.llm import bpe, tokencount

ODD = ["", " ", "\n\n\n", "a" * 5000, " " * 3000 + "x", "don't we'll they'RE 'r 've", "héllo wörld ñandú", "日本語テキスト", "a՘b\U0001df2b1\U00011de0", "x  y", "!!!'s''t", "\x1c\x1d\x85", "😀😃 12³½", "0123456789" * 50]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "aabcdeеéñ  \n\t'.,!#12日՘"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 80))) for _ in range(400)]


def library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(texts):
    own, theirs = bpe.codec(public_tokenizers.path(bpe.RANKS)), library(bpe.RANKS)
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), t[:50]
        assert own.decode(ids) == t.encode()


def test_dead_ends_stay_linear():
    own = bpe.codec(public_tokenizers.path(bpe.RANKS))
    t = "ab" * 20000
    assert own.decode(own.encode(t)) == t.encode()


def test_counts_and_prefixes_equal_the_library(texts):
    own = tokencount.counter(public_tokenizers.path(tokencount.VOCABULARY))
    theirs = Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY))
    count = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    for t in [*texts, "x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "a  <|endoftext|"]:
        assert own.count(t) == count(t), t[:50]
        if len(t) < 120:
            assert own.prefix_counts(t) == [count(t[:i]) for i in range(len(t) + 1)], t
            for budget in (0, 1, 3, 7):
                assert own.fit_fast(t, budget)[1] == max(i for i in range(len(t) + 1) if count(t[:i]) <= budget), (t, budget)


def test_queries_keep_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "héllo  there"), (5, "a b")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, token_ids string")
    got = bpe.digests(docs).collect()
    assert sorted(map(str, [r.doc_id for r in got])) == sorted(str(i) for i, _ in rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)} == {(0, empty, empty)}
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    counted = tokencount.count_tokens(docs, limit=2).collect()
    assert sorted((r.n_bytes, r.over_limit) for r in counted) == [(0, False), (0, False), (0, False), (3, False), (13, True)]
    assert bpe.digests(docs.limit(0)).count() == tokencount.count_tokens(docs.limit(0)).count() == 0


def test_character_classes_equal_the_library():
    split, theirs = bpe.Splitter(), Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY)).pre_tokenizer
    for c in [*range(0x20, 0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x20000), *range(0x2B700, 0x2B830), *range(0x2CE90, 0x2CEB0), *range(0x32300, 0x33480, 7), *range(0x3CFF0, 0x3FC50, 7)]:
        for t in ("a" + chr(c), "1" + chr(c), "!" + chr(c)):
            assert len(split(t)) == len(theirs.pre_tokenize_str(t)), hex(c)
