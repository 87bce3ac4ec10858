"""URL filters: rules first, then a score of host words and path tokens.

The host is cut into names at dots and other marks, and each name into words by unigram Viterbi: of all ways to
split it, the one whose words are likeliest by their counts in all pages' text. A multinomial naive Bayes model
over host words and path tokens, fitted on every page that a rule decides, judges the others.

Hosts, names and path shapes are judged once each and joined back; a name's dictionary is the part of the
word counts that the name contains, so no vocabulary is sent to all workers.

Defined cases: a null url, or one without "://", has an empty host and path and only the prior speaks; null html
has no words; repeated rows are judged alike; with no decided pages of one kind all others are allowed; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Longest word that a name is split into.
LONGEST = 24
SMOOTHING = 1.0


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (with host and path) with rule and ruling: the longest rule that fits, or null. rules is a short fixed list."""
    rule = ruling = F.lit(None).cast("string")
    for name, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = name.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        rule, ruling = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumn("rule", rule).withColumn("ruling", ruling)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word and n over the text of all pages, tags left out."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*>", " "))
    return pages.select(F.explode(F.split(text, "[^a-z0-9]+")).alias("word")).where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a name. A word without a count is likely as ten times one in ten to its length."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            p = math.log(n / total) if n else math.log(10 / max(total, 10)) - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and words of each distinct host."""
    common.ship(hosts.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = hosts.select("host", F.posexplode(F.split("host", "[^a-z0-9]+")).alias("at", "name")).where("name <> ''")
    names = named.select("name").distinct()
    parts = F.expr(f"explode(array_distinct(flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({LONGEST}, length(name) - i + 1)), k -> substr(name, i, k))))))")
    known = names.select("name", parts.alias("word")).join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [split_name(name, {x["word"]: x["n"] for x in own or []}, total) for name, own in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    words = names.join(known, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")
    found = named.join(words, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.select("host").join(found, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def shape(path: F.Column) -> F.Column:
    """The path's tokens, numbers as one token, joined by spaces."""
    tokens = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x)), " ")


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, host_words and score (log odds of block; null where a rule decides) of each row."""
    source = pages
    pages = ruled(parsed(pages.select(F.col(key), F.col(url).alias("url")), "url"), rules).withColumn("shape", shape(F.col("path")))
    hosts = pages.select("host").distinct()
    # stored tables: the html is split once, and joins whose sides come straight from a shuffle can be split where a key is hot
    counts = common.stored(word_counts(source.select(F.col(html).alias("html"))), "word-counts")
    words = common.stored(segmented(hosts, counts), "host-words")
    common.forget(counts)
    host_tokens = words.select("host", F.explode(F.transform("words", lambda w: F.concat(F.lit("host "), w))).alias("token"))
    shapes = pages.select("shape").distinct()
    shape_tokens = shapes.select("shape", F.explode(F.transform(F.filter(F.split("shape", " "), lambda x: x != ""), lambda w: F.concat(F.lit("path "), w))).alias("token"))
    # each decided page counts; pages of one host or shape are added up before their tokens are
    decided = pages.where(F.col("ruling").isNotNull())
    block, allow = F.sum((F.col("ruling") == "block").cast("long")).alias("block"), F.sum((F.col("ruling") == "allow").cast("long")).alias("allow")
    of_class = decided.agg(block, allow).first()
    n_block, n_allow = of_class[0] or 0, of_class[1] or 0
    seen = decided.groupBy("host").agg(block, allow).join(host_tokens, "host").select("token", "block", "allow").unionAll(decided.groupBy("shape").agg(block, allow).join(shape_tokens, "shape").select("token", "block", "allow"))
    tokens = common.stored(seen.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-tokens")
    k, all_block, all_allow = tokens.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    both = n_block > 0 and n_allow > 0
    prior = math.log(n_block / n_allow) if both else -1.0
    odds = F.log((F.col("block") + SMOOTHING) / F.lit(float((all_block or 0) + SMOOTHING * (k or 1)))) - F.log((F.col("allow") + SMOOTHING) / F.lit(float((all_allow or 0) + SMOOTHING * (k or 1))))
    odds = tokens.select("token", (odds if both else F.lit(0.0)).alias("odds"))
    score = lambda rows, by: common.stored(rows.join(odds, "token").groupBy(by).agg(F.sum(F.round("odds", 9)).alias(f"{by}_odds")), f"{by}-scores")
    by_host = common.stored(words.join(score(host_tokens, "host"), "host", "left"), "hosts")
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("shape_odds", F.lit(0.0))
    found = pages.join(by_host, "host", "left").join(score(shape_tokens, "shape"), "shape", "left")
    return found.select(
        key,
        "host",
        "path",
        "rule",
        F.coalesce("ruling", F.when(total > 0, "block").otherwise("allow")).alias("verdict"),
        F.col("words").alias("host_words"),
        F.when(F.col("ruling").isNull(), F.round(total, 6)).alias("score"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by the fixed rules or else by the model."""
    return judge(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))
