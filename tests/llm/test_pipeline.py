import base64
import os
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_decontam  # noqa: E402
import test_quality  # noqa: E402
import test_similar  # noqa: E402

from helixloom.llm import pii  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def plain(docs, items):
    kept = []
    for d in docs:
        n, _, _, _, repeat = test_quality.plain(d[1])
        if n >= 50 and 2 * repeat <= n:
            kept.append(d)
    roots = test_similar.plain_components([d[1] for d in kept])
    least = {}
    for d, r in zip(kept, roots):
        least[r] = min(least.get(r, d), d)
    kept = sorted(least.values())
    hit = {x[0] for x in test_decontam.plain(kept, items) if x[-1]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, t in kept:
        if i not in hit:
            t = pii.masked(t)
            out[i] = (t, enc.encode_ordinary(t))
    return out


def test_pipeline_equals_brute_force(spark):
    rows = lambda t, c: duckdb.sql(f"select {c}, text from '{SF}/{t}.parquet'").fetchall()
    expected = plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    got = {r.doc_id: (r.text, r.token_ids) for r in pipeline.run(spark, SF).collect()}
    assert got == expected and 20 < len(got)


def test_odd_rows_and_columns(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "a", "en", 9, "k"), (1, long, "a", "en", 9, "k"), (2, None, None, None, None, None), (None, long + " x y z", None, "en", 1, "r"), (4, "", "b", "en", 0, "m")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "text", "source", "lang", "n_words", "kept"]
    assert 1 in [r.doc_id for r in got.collect()]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


CLASHING = ["_version", "_doc", "_words", "_lines", "_windows", "_at", "_host", "_rejected", "_bytes", "row", "root", "node", "print", "k1", "of_id", "of_text", "goes", "id", "v", "hit_words", "token", "version", "key"]


def test_clashing_columns_pass_through(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(i, long if i % 3 else f"{long} tail {i} of it all", "a", *[f"{c}{i}" for c in CLASHING]) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source", *CLASHING, "token_ids", "n_tokens"]
    for r in got.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING)
