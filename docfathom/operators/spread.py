"""Joins, ranks and picks that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16
# A side this small, as counted, is broadcast to spare the other side a shuffle.
SENT_ROWS = 500_000
SENT_BYTES = 64 << 20


def sent_if_small(rows: DataFrame, *widths: Column, counted: DataFrame | None = None) -> DataFrame:
    """``rows``, marked for broadcast if counting shows them to be few and narrow.

    ``widths`` give the bytes of a row's long columns. Where one side of a join
    is a whole collection, the count is what keeps it from being shuffled: Spark
    cannot tell beforehand how small an aggregated batch will be. ``counted``, if
    given, has as many rows without the long columns; it is counted first.
    """
    width = sum((F.coalesce(w, F.lit(0)) for w in widths), F.lit(64)).cast("bigint")
    if counted is not None and counted.count() > SENT_ROWS:
        return rows
    size = rows.agg(F.count("*").alias("rows"), F.sum(width).alias("bytes")).first()
    if size.rows <= SENT_ROWS and (size.bytes or 0) <= SENT_BYTES:
        return F.broadcast(rows)
    return rows


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` to a lookup that has at most one row per key.

    Each lookup row is repeated ``salts`` times and ``spread`` sends the rows of
    one key to as many partitions. No size is assumed for the lookup: Spark
    broadcasts it if its measured size allows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def latest_per_key(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The row of each key with the greatest ``seq`` (unique within a key).

    The maximum combines before it is shuffled, and joining back on key *and*
    ``seq`` spreads a hot key's rows by ``seq``.
    """
    newest = rows.groupBy(*keys).agg(F.max(seq).alias(seq))
    return rows.join(newest, [*keys, seq], "left_semi")


def rank_within(
    rows: DataFrame, group: str, order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``.

    ``chunk`` must not decrease along ``order``. Only the rows of one chunk are
    sorted together; the counts of the chunks before it give its first number.
    The join reuses the partitioning of the window.
    """
    chunked = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(group, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [group, "_chunk"])
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_chunk", "_rank", "_offset")
    )


def one_row_each(rows: DataFrame, keys: Sequence[str], payload: Sequence[Column]) -> DataFrame:
    """One row of each key; of several, that with the least hash of its payload.

    Deliveries that were repeated leave equal rows, which are told apart by nothing
    and count once; should they differ, every run picks the same one. A key has as
    many rows as it was delivered.
    """
    order = Window.partitionBy(*keys).orderBy("_pick")
    numbered = rows.withColumn("_pick", F.xxhash64(*payload)).withColumn("_nth", F.row_number().over(order))
    return numbered.filter("_nth = 1").drop("_pick", "_nth")


def last_before(
    rows: DataFrame, key: str, order: str, value: str, name: str, floor: int, pieces: int = 64
) -> DataFrame:
    """``name``: the last ``value`` that is not NULL before each row of its key.

    A key's rows are cut into pieces of ``order``; only a piece is sorted at once,
    and the last values of the pieces before it are carried over. Rows up to
    ``floor`` are a piece of their own.
    """
    real = F.when(F.col(order) > floor, F.col(order))
    bounds = rows.groupBy(key).agg(F.min(real).alias("_lo"), F.max(real).alias("_hi"))
    share = (F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1.0)
    piece = F.when(F.col(order) > floor, F.floor(share * pieces)).otherwise(-1)
    cut = lookup_join(rows, bounds, [key], F.col(order)).withColumn("_piece", piece).drop("_lo", "_hi")
    ends = cut.groupBy(key, "_piece").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
    )
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_piece", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(key, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))
    return cut.join(ends, [key, "_piece"]).withColumn(name, found).drop("_piece", "_carried")
