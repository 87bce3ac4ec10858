"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts and two base rules. Rule failures are then counted by host (the source column); a
host's failure rate is shrunk towards all hosts' by a beta prior fitted to the hosts' rates by moments, and
documents of hosts whose shrunk rate passes HOST_LIMIT are rejected as well.

Defined cases: null or empty text has no words and fails; a null source is no host and is never judged as one;
repeated rows are judged alike; an empty table gives no rows. Windows of words are compared by 64-bit hashes
within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MAX_REPEAT = 50, 50
#: A host is rejected if more than this share of its documents is expected to fail.
HOST_LIMIT = 0.5
#: Most rejected hosts that are broadcast.
BROADCAST_HOSTS = 100_000
#: The prior counts as at least and at most so many documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1e6


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; such names are replaced."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    docs = docs.drop(*own)
    keep, text = [F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col("text"), F.lit(""))
    word_list, line_list, window_list, place_list = common.fresh(docs, "_words", "_lines", "_windows", "_at")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    first = docs.select(
        *keep,
        common.text_words(F.col("text")).alias(word_list),
        lines.alias(line_list),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    words, n = F.col(word_list), F.size(word_list)
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(line_list) - F.size(F.array_distinct(line_list))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias(window_list),
    )
    w = F.col(window_list)
    same = F.filter(w, lambda x, i: (F.get(w, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(w, i + 1)["h"].eqNullSafe(x["h"])))
    third = second.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.sort_array(F.transform(same, lambda x: x["i"])).alias(place_list))
    at = F.col(place_list)
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return third.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words")).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    )


def host_rates(judged: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """host, documents, failures and rate (shrunk) of each host of judged. Only one row of sums comes to the driver."""
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("documents"), F.sum(F.col(failed).cast("long")).alias("failures"))
    k, n, f, square = hosts.agg(F.count("*"), F.sum("documents"), F.sum("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("documents"))).first()
    mean = f / n if n else 0.0
    spread = max((square / n - mean * mean if n else 0.0) - (mean * (1 - mean) * k / n if n else 0.0), 1e-12)
    strength = min(max(mean * (1 - mean) / spread - 1, LEAST_PRIOR), MOST_PRIOR)
    return hosts.withColumn("rate", (F.col("failures") + mean * strength) / (F.col("documents") + strength))


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT, text: bool = True) -> DataFrame:
    """measured(docs) with kept; without the text column if it isn't asked for.

    The measured rows are stored once, so that texts are read and split once. Only hosts that are rejected are joined back.
    """
    rows = measured(docs)
    rows = common.stored(rows if text else rows.drop("text"), "quality")
    rows = rows.drop("kept")
    host, is_rejected = common.fresh(rows, "_host", "_rejected")
    rejected = host_rates(rows).where(F.col("rate") > host_limit).select(F.col("source").alias(host), F.lit(True).alias(is_rejected))
    # a counted few are sent to all tasks, so that texts stay where they are; more are joined by shuffling
    rejected = F.broadcast(rejected) if rejected.count() <= BROADCAST_HOSTS else rejected
    rows = rows.join(rejected, F.col("source") == F.col(host), "left")
    return rows.withColumn("kept", ~F.col("base_failed") & F.col(is_rejected).isNull()).drop(host, is_rejected)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    rows = judge(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"), text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM t),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM j WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS sq FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * k / n, 1e-12) - 1, 2.0), 1e6) AS s FROM m),
x AS (SELECT source FROM h, p WHERE (f + mean * s) / (n + s) > 0.5)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND x.source IS NULL AS kept
FROM j LEFT JOIN x ON j.source = x.source
"""
