"""Source divergence audit: how far each source's word use lies from its language's
and from the other sources of that language.

Method, single-pass in-memory indexing: each task reads its documents once and
holds postings in memory, keyed (lang, source, term) with occurrences and
documents, until ``BLOCK_POSTINGS`` keys are held; it then spills the block as a
run sorted by term and starts a new block. Runs are dealt to shards by a hash of
(lang, term); within a shard Spark's aggregation merges the runs into exact
frequencies (in memory while they fit, else by spilled sorted runs merged
through a heap).
Pair distances then start from the value every pair would have if neither source
used any term, and stream corrections for the terms the sources do use, so no
dense term-by-source grid is built.

Definitions (null text, lang and source are ''): terms are matches of
``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with only A-Z lower-cased. A language
keeps the V terms found in at least ``MIN_DOCS`` of its documents (rows; a
repeated row counts each time). For every occurring (lang, source) group, and
for each language, a kept term with ``count`` occurrences there has
``p = 1 + floor(1e9 * (count + 5) / (N + 5 V))``, N the sum of counts of kept
terms there. All arithmetic is exact (integers and decimals of 38 digits).

Result rows: (lang, source, part, item, value, rank).

- ``pair``: item is each other source of the language; value is the sum over all
  kept terms of |p - q|, q the other source's p (0 if V = 0); every rank.
- ``term``: item is each kept term the group uses (count > 0) whose p exceeds
  the language's; value is that difference; ranks 1 to ``TOP_TERMS``.

Ranks run from 1 within (lang, source, part) by value descending, then item by
UTF-8 bytes. A group without kept terms still has its pair rows; a language
with a single source has none. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from docfathom.session import materialize

#: Fixed values of the audit: documents a term needs, smoothing, scale, ranks shown.
MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50

#: Postings a task holds in memory before it spills a sorted run (about 100 bytes each).
BLOCK_POSTINGS = 1_000_000
#: Rows of one spilled Arrow batch.
RUN_BATCH = 65_536
#: A group's term rows are ranked in so many hashed parts first, then together.
RANK_SPREAD = 64

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

RUN_SCHEMA = "lang string, term string, source string, count long, docs long"


def terms(text: str | None) -> list[str]:
    """The terms of one text, in order."""
    return TERM.findall((text or "").translate(UPPER_TO_LOWER))


def block_runs(limit: int = BLOCK_POSTINGS):
    """A mapInArrow function: postings of a task's rows, spilled as sorted runs.

    A block holds one counter of occurrences and one of documents per (lang,
    source); counting happens inside ``Counter`` (C), and the block is spilled
    when its postings reach ``limit``.
    """

    def spill(counts: dict, docs: dict):
        import pyarrow as pa

        for lang, source in sorted(counts):
            occurrences, holding = counts[(lang, source)], docs[(lang, source)]
            names = sorted(occurrences)
            for at in range(0, len(names), RUN_BATCH):
                part = names[at : at + RUN_BATCH]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": [lang] * len(part),
                        "term": part,
                        "source": [source] * len(part),
                        "count": pa.array([occurrences[t] for t in part], pa.int64()),
                        "docs": pa.array([holding[t] for t in part], pa.int64()),
                    }
                )

    def run(batches):
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            sources = batch.column("source").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang, source, text in zip(langs, sources, texts):
                found = terms(text)
                if not found:
                    continue
                key = (lang or "", source or "")
                occurrences = counts.get(key)
                if occurrences is None:
                    occurrences = counts[key] = Counter()
                    docs[key] = Counter()
                before = len(occurrences)
                occurrences.update(found)
                docs[key].update(set(found))
                held += len(occurrences) - before
                if held >= limit:
                    yield from spill(counts, docs)
                    counts, docs, held = {}, {}, 0
        if counts:
            yield from spill(counts, docs)

    return run


def frequencies(docs: DataFrame, limit: int = BLOCK_POSTINGS) -> DataFrame:
    """(lang, term, source, count, docs) of every term a group uses, exact.

    The runs are dealt to shards by (lang, term); within a shard Spark's
    aggregation merges them (hashing in memory, spilling sorted runs and merging
    them when memory fills). The result stays dealt by (lang, term), which the
    per-language counts and joins below reuse.
    """
    rows = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("text"),
    )
    runs = rows.mapInArrow(block_runs(limit), RUN_SCHEMA)
    return runs.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 kept)) of named columns, exact.

    ``div`` divides decimals exactly and truncates, which is floor here.
    """
    return F.expr(
        f"CAST(1 + (CAST({count} + {SMOOTHING} AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0)))"
        f" div CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(20,0)) AS BIGINT)"
    )


def ranked(rows: DataFrame, most: int | None) -> DataFrame:
    """Rank rows within (lang, source, part) by value descending, then item.

    With ``most``, each group is first cut to ``most`` rows within hashed parts of
    its items, so a group with a large vocabulary is ranked by many tasks.
    """
    order = [F.col("value").desc(), F.col("item").asc()]
    group = ["lang", "source", "part"]
    if most is not None:
        spread = F.pmod(F.xxhash64("item"), F.lit(RANK_SPREAD))
        first = Window.partitionBy(*group, spread).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if most is not None:
        rows = rows.filter(F.col("rank") <= most)
    return rows


def audit(docs: DataFrame, limit: int = BLOCK_POSTINGS) -> DataFrame:
    """Pair and term rows of every (lang, source) group, as the module states.

    The frequencies, the per-group figures and the kept sparse rows are each
    written once to the checkpoint folder: later parts read them several times,
    and a lost executor does not send the texts through again.
    """
    freq = materialize(frequencies(docs, limit))
    groups = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    ).distinct()

    kept = (
        freq.groupBy("lang", "term")
        .agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= MIN_DOCS)
        .drop("docs")
    )
    langs = (
        groups.select("lang").distinct()
        .join(kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("lang_count").alias("lang_N")), "lang", "left")
        .select(
            "lang",
            F.coalesce("V", F.lit(0)).cast("long").alias("V"),
            F.coalesce("lang_N", F.lit(0)).cast("long").alias("lang_N"),
        )
    )
    used = freq.join(kept, ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("N"), F.count("*").alias("A"))
    stats = materialize(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
        .select(
            "lang", "source", "V", "lang_N",
            F.coalesce("N", F.lit(0)).cast("long").alias("N"),
            F.coalesce("A", F.lit(0)).cast("long").alias("A"),
        )
        .withColumn("z", F.when(F.col("V") > 0, share("0", "N", "V")))
    )
    sparse = materialize(
        used.join(stats, ["lang", "source"]).select(
            "lang", "source", "term", "z",
            share("count", "N", "V").alias("p"),
            share("lang_count", "lang_N", "V").alias("q"),
        )
    )
    term_rows = sparse.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value"),
    )
    return ranked(pair_rows(sparse, stats), None).unionByName(ranked(term_rows, TOP_TERMS))


def pair_rows(sparse: DataFrame, stats: DataFrame) -> DataFrame:
    """Sum over kept terms of |p_a - p_b| for every ordered pair of sources of a language.

    With z a group's p of an unused term, A its used terms and P their sum of p:
    value = S(a, b) + S(b, a) + (V - |A| - |B|) |z_a - z_b| + C(a, b), where
    S(a, b) = sum over A of |p_a - z_b| = P_a - |A| z_b + 2 sum over A, p_a < z_b, of (z_b - p_a),
    and C adds, for the terms both use, |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|
    (V - |A| - |B| counts each of them once below zero). Only pairs of sources
    that share a term meet in a join of term rows; all other work is per group.
    """
    a = stats.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("A").alias("Aa"), "V")
    b = stats.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("A").alias("Ab"))
    pairs = a.join(b, "lang").filter(F.col("a") != F.col("b"))

    # Terms of one count share p: so many (p, terms) rows per group as it has distinct counts.
    levels = sparse.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    carried = ["V", "za", "zb", "Aa", "Ab"]
    asked = pairs.select("lang", "a", "b", F.col("zb").alias("p"), F.lit(None).cast("long").alias("terms"), *carried)
    running = Window.partitionBy("lang", "a").orderBy("p", F.col("terms").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("lang", "a")
    weight = F.coalesce(F.col("p") * F.col("terms"), F.lit(0))
    known = levels.select(
        "lang", "a", F.lit(None).cast("string").alias("b"), "p", "terms",
        *[F.lit(None).cast("long").alias(c) for c in carried],
    )
    one_side = materialize(
        known.unionByName(asked)
        .withColumn("n_below", F.sum(F.coalesce("terms", F.lit(0))).over(running))
        .withColumn("p_below", F.sum(weight).over(running))
        .withColumn("total_p", F.sum(weight).over(whole))
        .filter(F.col("terms").isNull())
        .select(
            "lang", "a", "b", *carried,
            (F.col("total_p") - F.col("Aa") * F.col("zb") + 2 * (F.col("n_below") * F.col("p") - F.col("p_below"))).alias("side"),
        )
    )

    left = sparse.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = sparse.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    both = (
        left.join(right, ["lang", "term"]).filter(F.col("a") != F.col("b"))
        .groupBy("lang", "a", "b")
        .agg(F.sum(
            F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb"))
            - F.abs(F.col("za") - F.col("pb")) + F.abs(F.col("za") - F.col("zb"))
        ).alias("fix"))
    )

    mirrored = one_side.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("side").alias("back"))
    return (
        one_side.join(mirrored, ["lang", "a", "b"]).join(both, ["lang", "a", "b"], "left")
        .select(
            "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
            F.when(F.col("V") == 0, F.lit(0).cast("long")).otherwise(
                F.col("side") + F.col("back")
                + (F.col("V") - F.col("Aa") - F.col("Ab")) * F.abs(F.col("za") - F.col("zb"))
                + F.coalesce("fix", F.lit(0))
            ).cast("long").alias("value"),
        )
    )
