"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of
``documents``. Rows that stay are those whose text is in a language that the labels
teach, that are the best of their exact copies, and the first of their near copies;
personal data in them is replaced, and the last stage packs them.

Nulls, empty texts and repeated rows have the results that the operators state:
texts without a letter go in the first stage, and without any language label only
those do. Empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docfathom.llm import cuckoo, language, neardup, packing, surrogates
from docfathom.llm.queries import SURROGATE_KEY, vocabulary
from docfathom.llm.text import bound_batches, table
from docfathom.session import checkpoint_dir, ship_package

#: A text of which its best language knows a smaller share of trigrams is in none.
LEAST_KNOWN = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(ship_package(spark))
    return language.keep_known(docs, language.fit(docs.filter(language.learns())), LEAST_KNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(ship_package(spark))
    return cuckoo.keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(ship_package(spark))
    return neardup.keep_one_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace_text(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(ship_package(spark))
    return packing.digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: Filters of trigrams, signatures and keyed surrogates have no SQL; the tests run
#: the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
