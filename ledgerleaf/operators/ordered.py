"""Ordered scans that never put a whole group, or the whole table, into one task.

A plain window sorts each partition key in one task, which fails when one key (or no key at all) holds a large share
of the rows. Here the rows are range-partitioned on (keys, order), so that even a hot key spreads evenly over chunks.
Windows then run per (keys, chunk), and only the keys that cross a chunk border need a carried-in value. Each border
is crossed by at most one key, so the carry table has fewer rows than there are chunks and its broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.store import materialize

CHUNK = "_chunk"
ROWS_PER_CHUNK = 1 << 20


def chunk_count(df: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> int:
    """Chunks for the rows of ``df``, at least as many as there are shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_chunk))


def chunk_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition on (keys, order) and keep the partition number as ``_chunk``.

    The number of chunks follows the number of rows. The input is written first, so that counting it and sampling the
    borders doesn't compute it again; the result is written because every reader must see the same borders.
    """
    df = materialize(df, "rows")
    ranged = df.repartitionByRange(chunk_count(df), *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(ranged, "chunks")


def border_keys(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in more than one chunk: at most one per chunk border."""
    key = F.struct(*keys)
    ends = chunked.groupBy(CHUNK).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    both = ends.select(CHUNK, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))
    return both.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key.*")


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order``; the order must be unique."""
    df = materialize(df, "rows")
    chunked = materialize(df.repartitionByRange(chunk_count(df), *order).withColumn(CHUNK, F.spark_partition_id()), "chunks")
    # One row per chunk, so this window is as small as the number of chunks.
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        chunked.groupBy(CHUNK).agg(F.sum(value).alias("_sum")).select(CHUNK, F.sum("_sum").over(before).alias("_carry"))
    )
    within = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(value).over(within)
    return (
        chunked.withColumn(name, running)
        .join(F.broadcast(carry), CHUNK)
        .withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop(CHUNK, "_carry")
    )


def forward_fill(df: DataFrame, source: str, order: str, columns: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Carry the last non-null value of each column down the rows of a source.

    Chunks are blocks of consecutive ``order`` numbers, so one huge source is filled by many tasks. The input is read
    twice; write it first if computing it is dear.
    """
    chunked = df.withColumn(CHUNK, F.expr(f"{order} div {rows_per_chunk}"))
    within = Window.partitionBy(source, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(source).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    last = chunked.groupBy(source, CHUNK).agg(
        *[F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in columns]
    )
    carry = last.select(source, CHUNK, *[F.last(c, ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    filled = chunked.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in columns})
    joined = filled.join(carry, [source, CHUNK], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns}).select(*df.columns)
