"""Packing without padding: every document falls into pieces of binary lengths.

A document of n ids becomes n // 2048 pieces of 2048 ids and, for the rest, one
piece for each bit set in n % 2048, longest first. A piece is a sequence of its
own, so no sequence crosses documents and none is padded; batches are made within
a bucket of equal lengths, and write_buckets() lays the sequences out that way.

Null text is empty; an empty text still has the closing id, so every row yields a
piece. Rows are handled one by one: repeated rows and null ids pass like others.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfathom.llm.text import texts

MAX_LENGTH = 2048
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, "
    "sequence_id long, offset long"
)
#: Ids of one batch of pieces that leaves a task.
HELD_IDS = 1 << 20
#: Where both libraries agree by test on every character; other texts, and those
#: with a special token, go through the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ſ]*")


@functools.cache
def _encoder(vocabulary: str):
    """A function from a text to its ids (little-endian unsigned 32-bit)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    full = Tokenizer.from_file(vocabulary)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    ranks_file = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if os.path.exists(ranks_file):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    else:
        fast = None

    def encode(text: str) -> np.ndarray:
        if fast and PLAIN.fullmatch(text) and not any(s in text for s in special):
            return np.array(fast(text), "<u4")
        return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n ids: whole ones, then the bits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [
        1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1
    ]


def pack(docs: DataFrame, vocabulary: str, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: where it comes from, its ids, its bucket and sequence.

    ``ids`` are little-endian unsigned 32-bit integers; ``bucket`` is the binary
    logarithm of the length. ``sequence_id`` counts the pieces of a partition, so
    numbering needs no shuffle and no second pass.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence has to be a power of two")

    def run(batches):
        encode = _encoder(vocabulary)
        rows, held = [], 0

        def out():
            columns = [list(c) for c in zip(*rows)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(encode(text), np.array([END_ID], "<u4"))
                data, start, total = ids.tobytes(), 0, len(ids)
                for length in binary_lengths(total, longest):
                    rows.append((doc_id, start, length, data[4 * start : 4 * (start + length)], total))
                    start += length
                held += total
                if held >= HELD_IDS:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences so that equal lengths lie together (``bucket=``...).

    Each task writes its own file per bucket: nothing is shuffled, and no bucket,
    however common its length, meets in one task.
    """
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )
