"""Ranks of rows within keys, by range chunks: a hot key is spread over tasks like any other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.ordered import CHUNK, chunk_by_range, same_key
from ledgerleaf.store import materialize


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Number the rows of each key from 0 in ``order``; rows that tie are numbered in any order.

    Without keys the whole table is numbered. ``total`` names a column for the number of rows of the key. Nulls come
    first and are a key of their own.
    """
    chunked = chunk_by_range(df, keys, order)
    counts = chunked.groupBy(CHUNK, *keys).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each chunk and key in it.
    carry = counts.withColumns({"_carry": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(of_key)})
    carry = materialize(carry.drop("_n"), "carry")
    within = Window.partitionBy(CHUNK, *keys).orderBy(*order)
    ranked = chunked.withColumn("_rank", F.row_number().over(within))
    joined = ranked.join(carry, same_key(ranked, carry, [CHUNK, *keys]), "inner")
    more = [carry["_total"].alias(total)] if total else []
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_rank") - 1 + F.col("_carry")).alias(name), *more)
