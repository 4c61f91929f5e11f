"""Quality rules judged per document and per host.

Base rules (fixed by the contract). Words are matches of ``[^\\x20\\x09-\\x0D]+``
of the whole text (null: no words). Per document:

- ``word_chars``: code points in words;
- ``n_symbols``: characters of ``[#*$%&|<>]``;
- ``n_dup_lines``: lines (split at ``\\n``) holding a word that equal an earlier line;
- ``n_repeat_words``: words covered by a 3-word window that occurs twice or more in
  the text, its first occurrence included;
- ``base_failed``: fewer than 50 words, or more than half of them repeated.

Method, host-level rules: each document is also held to the soft rules below; a
document fails when it fails a base or a soft rule. Failures are counted by host
(``source``; null is ''), and each host's failure rate is shrunk towards the rate
of all hosts by an empirical Beta prior, fitted by the method of moments over the
hosts' rates. A host whose shrunk rate exceeds ``HOST_LIMIT`` is a bad host, and
its verdict is joined back to its documents: ``kept`` is false when the base
rules fail, or when a document fails a soft rule *and* its host is bad. A
document that passes every rule is kept wherever it comes from; a soft failure on
a good host is forgiven.

Soft rules: symbols above ``MOST_SYMBOLS`` of words; duplicate lines above
``MOST_DUP_LINES`` of lines with a word; mean word length outside
``WORD_LENGTH``.

Rows are never merged: repeated rows and null ids are rows of their own, empty
and null texts fail the base rules, and an empty table gives no rows. Columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from docfathom.operators.spread import lookup_join
from docfathom.session import materialize

#: Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
WINDOW = 3
SYMBOLS = "#*$%&|<>"

#: The method's soft rules and host verdict.
MOST_SYMBOLS = 0.1
MOST_DUP_LINES = 0.3
WORD_LENGTH = (3.0, 10.0)
HOST_LIMIT = 0.5
#: Bounds of the prior's weight (alpha + beta), so that one host or equal rates still give a prior.
PRIOR_WEIGHT = (2.0, 1_000_000.0)

WORD = re.compile(r"[^\x20\x09-\x0D]+")

STATS_SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, word_lines long"
)


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_lines) of a text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = bytearray(n)
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered[at : at + WINDOW] = b"\x01" * WINDOW
    return n, chars, symbols, duplicates, sum(covered), lines


def document_stats(batches):
    """A mapInArrow function: the counts of every row."""
    import pyarrow as pa

    for batch in batches:
        rows = [counts(t) for t in batch.column("text").to_pylist()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_lines"]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "host": batch.column("host"),
                **{name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(names)},
            }
        )


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def soft_failed():
    # No words: no mean length, and that rule is not failed.
    mean_length = F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))
    return (
        (F.col("n_symbols") > F.col("n_words") * MOST_SYMBOLS)
        | (F.col("n_dup_lines") > F.col("word_lines") * MOST_DUP_LINES)
        | F.coalesce((mean_length < WORD_LENGTH[0]) | (mean_length > WORD_LENGTH[1]), F.lit(False))
    )


def host_verdicts(stats: DataFrame) -> DataFrame:
    """(host, docs, failures, shrunk, bad) of every host.

    The prior is two numbers, the mean and variance of the hosts' rates, read by
    one aggregate; they then enter the plan as literals.
    """
    hosts = stats.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    rate = F.col("failures") / F.col("docs")
    m, w = prior(hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first())
    shrunk = (F.col("failures") + F.lit(m * w)) / (F.col("docs") + F.lit(w))
    return hosts.select("host", "docs", "failures", shrunk.alias("shrunk")).withColumn("bad", F.col("shrunk") > HOST_LIMIT)


def prior(moments) -> tuple[float, float]:
    """(mean, weight alpha + beta) of the Beta prior by the method of moments."""
    m, v = (moments.m or 0.0) if moments else 0.0, (moments.v or 0.0) if moments else 0.0
    weight = m * (1 - m) / v - 1 if v > 0 else PRIOR_WEIGHT[1]
    return m, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def judge(docs: DataFrame) -> DataFrame:
    """Every row with its counts, base verdict, host verdict and ``kept``."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("source"), F.lit("")).alias("host"))
    stats = materialize(
        rows.mapInArrow(document_stats, STATS_SCHEMA)
        .withColumn("base_failed", base_failed())
        .withColumn("soft_failed", soft_failed())
        .withColumn("failed", F.col("base_failed") | F.col("soft_failed"))
    )
    verdicts = host_verdicts(stats).select("host", F.col("shrunk").alias("host_rate"), F.col("bad").alias("host_bad"))
    # A host may hold a third of the rows: its verdict is repeated to several salts.
    joined = lookup_join(stats, verdicts, ["host"], F.xxhash64("doc_id", "n_words", "word_chars"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(F.col("soft_failed") & F.col("host_bad"))).alias("kept"),
        "soft_failed", "host", "host_rate", "host_bad",
    )
