"""The operators over the given tables, by query name, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docfathom.llm import (
    blockjoin,
    bpe,
    cuckoo,
    divergence,
    host_rules,
    language,
    licenses,
    neardup,
    packing,
    quality,
    secret_scan,
    surrogates,
    whitening,
)
from docfathom.llm.text import bound_batches, held_out, table
from docfathom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(bound_batches(ship_package(spark)), sf_dir)

    QUERIES[function.__name__] = run
    return function


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(language.learns()))
    # Only what a prediction may see goes in.
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score"
    )


@query
def op4_cuckoo_dedup(spark, sf_dir):
    return cuckoo.dedup(table(spark, sf_dir, "documents"))


ORACLE["op4_cuckoo_dedup"] = r"""
WITH bare AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare,
           length(coalesce(text, '')) AS points
    FROM documents
), kept AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY bare) AS group_size
    FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM kept
"""


@query
def op6_binary_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


@query
def op10_minhash_bayes(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


#: Whoever releases a corpus chooses a key of their own and keeps it.
SURROGATE_KEY = "example key"


@query
def op3_surrogates(spark, sf_dir):
    done = surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return done.select("row.doc_id", "text", "n_entities", "kinds")


@query
def op7_word_bpe(spark, sf_dir):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_secret_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ledger = secret_scan.scan_new(docs, path="doc_id")
    found = secret_scan.findings_by_path(docs, ledger, path="doc_id")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>"))
    base = [r.name for r in secret_scan.BASE_RULES]

    def written(some):
        return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(written(F.filter(spans, lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        written(spans).alias("spans"),
    )


@query
def op8_license_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.build_index(docs))


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(quality.learns()))
    return quality.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted"
    )


@query
def op5_block_join(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return blockjoin.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


@query
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op11_source_divergence"] = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), occ AS (
    SELECT lang, source, rid, unnest(terms) AS term FROM d
), groups AS (
    SELECT DISTINCT lang, source FROM d
), kept AS (
    SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), langs AS (
    SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang
), used AS (
    SELECT lang, source, term, count(*) AS cnt FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(u.cnt, 0) AS cnt
    FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), gp AS (
    SELECT grid.*, 1 + (1000000000::HUGEINT * (cnt + 5)) // (sum(cnt) OVER (PARTITION BY lang, source) + 5 * v) AS p
    FROM grid JOIN langs USING (lang)
), lp AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q
    FROM (SELECT lang, term, sum(cnt) AS c FROM grid GROUP BY lang, term) JOIN langs USING (lang)
), pair_values AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY x.lang, x.source, y.source
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_values pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
    UNION ALL
    SELECT gp.lang, gp.source, 'term', gp.term, gp.p - lp.q
    FROM gp JOIN lp USING (lang, term) WHERE gp.cnt > 0 AND gp.p > lp.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rnk FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rnk AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rnk <= 50
"""


@query
def op12_embedding_whitening(spark, sf_dir):
    # Eigenvectors have no SQL; the tests hold them against exact moments and numpy.
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_host_rules(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE["op13_host_rules"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), w AS (
    SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d
), triples AS (
    SELECT rid, pos, word, lead(word, 1) OVER (PARTITION BY rid ORDER BY pos) AS second,
           lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS third
    FROM w
), win AS (
    SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, second, third) AS seen FROM triples WHERE third IS NOT NULL
), covered AS (
    SELECT rid, count(*) AS n_repeat_words FROM (
        SELECT rid, pos FROM win WHERE seen > 1
        UNION SELECT rid, pos + 1 FROM win WHERE seen > 1
        UNION SELECT rid, pos + 2 FROM win WHERE seen > 1
    ) GROUP BY rid
), lines AS (
    SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY place) AS nth
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT rid, count(*) AS word_lines, count(*) FILTER (WHERE nth > 1) AS n_dup_lines FROM lines GROUP BY rid
), stats AS (
    SELECT d.rid, d.doc_id, d.host,
           CAST(len(d.words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(d.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           coalesce(dup.word_lines, 0) AS word_lines,
           CAST(coalesce(covered.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN covered USING (rid) LEFT JOIN dup USING (rid)
), judged AS (
    SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
           n_symbols > n_words * 0.1 OR n_dup_lines > word_lines * 0.3
           OR (n_words > 0 AND (word_chars / n_words < 3.0 OR word_chars / n_words > 10.0)) AS soft_failed
    FROM stats
), hosts AS (
    SELECT host, count(*) AS docs, sum(CAST(base_failed OR soft_failed AS BIGINT)) AS failures FROM judged GROUP BY host
), prior AS (
    SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000000.0 END, 2.0), 1000000.0) AS w
    FROM (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v FROM hosts)
), verdicts AS (
    SELECT host, (failures + (SELECT m * w FROM prior)) / (docs + (SELECT w FROM prior)) > 0.5 AS bad FROM hosts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND bad) AS kept
FROM judged JOIN verdicts USING (host)
"""
