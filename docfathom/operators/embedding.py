"""Turning text into vectors with a pluggable embedder."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docfathom.functions.documents import text_hash
from docfathom.operators.similarity import search_topk_batch, split_queries
from docfathom.schemas import (
    EMBED_BASE_DELAY_SECONDS,
    EMBED_BATCH_SIZE,
    EMBED_JITTER_SECONDS,
    EMBED_MAX_ATTEMPTS,
)
from docfathom.session import materialize

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

RESULT_TYPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
    ]
)
RESULT_ARROW = pa.schema(
    [
        ("id", pa.string()),
        ("text_hash", pa.string()),
        ("embedding", pa.list_(pa.float32())),
        ("error", pa.string()),
        ("attempts", pa.int32()),
        ("batch_size", pa.int32()),
    ]
)


class RetryableEmbedError(Exception):
    """The call may work later: rate limit, server error, lost connection."""


class PermanentEmbedError(Exception):
    """The call will not work however often it is made."""


class HashEmbedder:
    """Counts of hashed words, scaled to length one. Needs no service.

    A word is a run of characters between blanks, tabs and line ends; its
    dimension is the first 32 bits of its MD5, modulo ``dims``.
    """

    WORD_BREAK = re.compile(r"[ \t\n\r]+")
    #: Words whose place is remembered, and the longest of them, so that a worker's
    #: memory does not grow with the words of the collection.
    KNOWN_WORDS = 100_000
    KNOWN_LENGTH = 64

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._vector(text) for text in texts]

    def _vector(self, text: str) -> np.ndarray:
        places = [self._place(word) for word in self.WORD_BREAK.split(text) if word]
        counts = np.bincount(places, minlength=self.dims) if places else np.zeros(self.dims)
        length = np.sqrt(counts @ counts)
        return (counts / length if length else counts).astype(np.float32)

    def _place(self, word: str) -> int:
        place = self.known.get(word)
        if place is None:
            place = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims
            if len(word) <= self.KNOWN_LENGTH:
                if len(self.known) >= self.KNOWN_WORDS:
                    self.known.clear()
                self.known[word] = place
        return place


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used.

    Spark merges projections, and a column that stands in another's lambda would
    be computed anew for every element that the lambda is called with.
    """
    return F.transform(F.array(value), use)[0]


def hash_weights(docs: DataFrame, dims: int = 64) -> DataFrame:
    """``HashEmbedder``'s non-zero elements by column functions: ``(id, place, weight)``.

    Everything happens inside the row (split, hash, count per place, length), so
    no text is shuffled: the plan is a scan and a generator. A word is hashed once,
    and equal places are counted as runs of the sorted places. Each row is a
    document of its own; null and empty texts give no elements.
    """
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda word: word != "")
    places = F.transform(
        words,
        lambda word: F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int"),
    )

    def run_ends(places: Column) -> Column:
        last = F.transform(
            places,
            lambda place, i: F.when(
                ~place.eqNullSafe(F.get(places, i + 1)), F.struct(place.alias("place"), (i + 1).alias("upto"))
            ),
        )
        return F.filter(last, lambda end: end.isNotNull())

    def run_lengths(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda end, i: F.struct(
                end["place"].alias("place"),
                (end["upto"] - F.coalesce(F.get(ends, i - 1)["upto"], F.lit(0))).cast("bigint").alias("n"),
            ),
        )

    def weights(counted: Column) -> Column:
        squares = F.aggregate(counted, F.lit(0).cast("bigint"), lambda total, x: total + x["n"] * x["n"])
        return _bound(
            F.sqrt(squares),
            lambda length: F.transform(
                counted, lambda x: F.struct(x["place"].alias("place"), (x["n"] / length).alias("weight"))
            ),
        )

    ends = _bound(F.sort_array(places), run_ends)
    return docs.select("id", F.inline(_bound(_bound(ends, run_lengths), weights)))


def call_with_retry(
    embedder: Embedder,
    texts: list[str],
    dims: int | None = None,
    max_attempts: int = EMBED_MAX_ATTEMPTS,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[Sequence[Sequence[float]], int]:
    """Vectors of one batch and the number of calls it took.

    Retryable failures wait twice as long each time, with some jitter. The reply
    must hold one vector per text, each of ``dims`` elements.
    """
    for attempt in range(1, max_attempts + 1):
        try:
            vectors = embedder(texts)
        except (RetryableEmbedError, ConnectionError, TimeoutError) as error:
            if attempt == max_attempts:
                raise RetryableEmbedError(f"gave up after {attempt} calls: {error}") from error
            delay = EMBED_BASE_DELAY_SECONDS * 2 ** (attempt - 1)
            sleep(delay + random.uniform(0, EMBED_JITTER_SECONDS))
            continue
        if len(vectors) != len(texts):
            raise PermanentEmbedError(f"{len(vectors)} vectors for {len(texts)} texts")
        if dims is not None and any(len(vector) != dims for vector in vectors):
            raise PermanentEmbedError(f"a vector does not have {dims} elements")
        return vectors, attempt
    raise ValueError("max_attempts must be at least 1")


def embed_batch(
    embedder: Embedder, texts: list[str], **retry
) -> list[tuple[Sequence[float] | None, str | None, int]]:
    """``(vector, error, attempts)`` per text, in order.

    A batch that cannot work is halved until only the bad texts are left.
    """
    if not texts:
        return []
    limit = retry.get("max_attempts", EMBED_MAX_ATTEMPTS)
    try:
        vectors, attempts = call_with_retry(embedder, texts, **retry)
        return [(vector, None, attempts) for vector in vectors]
    except RetryableEmbedError as error:
        return [(None, str(error), limit) for _ in texts]
    except Exception as error:  # noqa: BLE001 - anything the embedder raises is the rows' error
        if len(texts) == 1:
            return [(None, str(error), 1)]
        middle = len(texts) // 2
        return [
            *embed_batch(embedder, texts[:middle], **retry),
            *embed_batch(embedder, texts[middle:], **retry),
        ]


def embed_documents(
    docs: DataFrame,
    embedder: Embedder,
    dims: int | None = None,
    batch_size: int = EMBED_BATCH_SIZE,
    max_attempts: int = EMBED_MAX_ATTEMPTS,
    spread: bool = False,
    partitions: int | None = None,
    keep: Sequence[str] = (),
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """One result per document ``(id, text)``; schema ``RESULT_TYPE`` and ``keep``.

    Each partition calls the embedder with up to ``batch_size`` texts at a time,
    so the number of partitions bounds the calls in flight: the scan's own, or
    with ``spread`` those of a shuffle by id (``partitions`` of them, if given),
    which pays where a call costs more than moving its texts. Tasks may be repeated,
    so the embedder must give the same vectors again, and a costly embedder's
    output should be written (``materialize``) before it is used twice.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _slices(batches, batch_size):
            texts = group.column("text").to_pylist()
            done = embed_batch(embedder, texts, dims=dims, max_attempts=max_attempts, sleep=sleep)
            yield pa.record_batch(
                [
                    group.column("id"),
                    group.column("text_hash"),
                    pa.array(
                        [None if v is None else np.asarray(v, np.float32) for v, _, _ in done],
                        RESULT_ARROW.field("embedding").type,
                    ),
                    pa.array([error for _, error, _ in done], pa.string()),
                    pa.array([attempts for _, _, attempts in done], pa.int32()),
                    pa.array([len(texts)] * len(texts), pa.int32()),
                    *[group.column(name) for name in keep],
                ],
                names=[*RESULT_ARROW.names, *keep],
            )

    texts = docs.select("id", "text", text_hash(F.col("text")).alias("text_hash"), *keep)
    if partitions:
        texts = texts.repartition(partitions, "id")
    elif spread:
        texts = texts.repartition("id")
    schema = T.StructType([*RESULT_TYPE.fields, *(docs.schema[name] for name in keep)])
    return texts.mapInArrow(embed, schema)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut a stream of Arrow batches into batches of ``size``, the last one smaller."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, size - count)
            waiting.append(part)
            count += part.num_rows
            start += part.num_rows
            if count == size:
                yield pa.concat_batches(waiting)
                waiting, count = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def embed_queries(
    queries: DataFrame, embedder: Embedder, dims: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Queries with their vector, and the others with the reason they have none.

    Equal texts are embedded once. The vectors are written before they are used,
    so the embedder is not called again by later steps.
    """
    valid, rejected = split_queries(queries)
    texts = valid.select(F.col("query").alias("text")).distinct()
    texts = texts.withColumn("id", text_hash(F.col("text")))
    vectors = materialize(embed_documents(texts, embedder, dims, **options))
    found = vectors.select(
        F.col("id").alias("query_hash"),
        F.col("embedding").alias("query_vec"),
        F.col("error").alias("reject_reason"),
    )
    answered = valid.withColumn("query_hash", text_hash(F.col("query"))).join(found, "query_hash")
    failed = answered.filter("reject_reason IS NOT NULL").select(*rejected.columns)
    return answered.filter("reject_reason IS NULL").drop("reject_reason"), rejected.unionByName(failed)


def search_text_topk(
    corpus: DataFrame, queries: DataFrame, embedder: Embedder, dims: int | None = None, **options
) -> DataFrame:
    """Top-k for queries ``(query_id, tenant_id, query, limit)`` given as text.

    Empty queries, and those the embedder fails on, have no hits; ``embed_queries``
    names them.
    """
    asked, _ = embed_queries(queries, embedder, dims)
    return search_topk_batch(corpus, asked.drop("query"), **options)
