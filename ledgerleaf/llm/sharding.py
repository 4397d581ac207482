"""Sharding by proportional stratified interleaving (SQL functions only).

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank + 1/2) / rows puts every
source evenly on the line from 0 to 1. The rows in that order are cut into shards of equal counts, so each shard holds
every source in its share, to within a row. Ranks come from range chunks, so a hot source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import CRC_TABLE, unit_hash
from ledgerleaf.llm.ranks import rank_within
from ledgerleaf.store import materialize

SHARDS = 8


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = "shard") -> DataFrame:
    """One row for each document: doc_id, source, size, text_crc32, shard (from 0), slot (gapless from 0 in its shard).

    Size is the number of UTF-8 bytes of the text plus 1. Counts of shards differ by one at most.
    Defined cases: a null text counts as empty; null is a source of its own; repeated rows each have a slot; fewer rows
    than shards leave shards empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        unit_hash(seed, F.col("doc_id")).alias("_h"),
    )
    small = materialize(small, "sizes")
    rows = small.count()
    counts = materialize(small.groupBy("source").agg(F.count(F.lit(1)).alias("_of")), "sources").alias("c")
    order = ["_h", "doc_id", "size", "text_crc32"]
    ranked = rank_within(small, ["source"], order, "_rank").alias("r")
    placed = ranked.join(counts, F.col("r.source").eqNullSafe(F.col("c.source"))).select(
        "r.*", ((2 * F.col("_rank") + 1) / (2.0 * F.col("_of"))).alias("_place")
    )
    numbered = rank_within(placed, [], ["_place", "source", *order], "_at")
    shard = F.expr(f"_at * {shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the law is ``rows``."""
    out = interleave(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = f"""
WITH {CRC_TABLE}, bytes AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS codes
  FROM documents
), sizes AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST('0x' || substr(md5('shard|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM bytes, crc_table
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1) / (2.0::DOUBLE * count(*) OVER (PARTITION BY source)) AS place,
         count(*) OVER () AS n
  FROM sizes
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY place, source COLLATE "C" NULLS FIRST, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS spot FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(spot * {SHARDS} // n AS INT) AS shard,
       CAST(spot - (spot * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered
"""
