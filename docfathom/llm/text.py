"""Helpers that several operators share: reading tables, bounded batches, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from docfathom.session import bound_batches  # noqa: F401 - used from here by the operators on texts

#: Maps A-Z to a-z and every ASCII byte that is no letter or digit to a space.
ALNUM = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch, name: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8; null is the empty text."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring items as (from, to), each run of ``most`` in all or one item."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id's decimal text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
