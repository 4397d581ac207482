"""Mixing sources to target weights by hash-threshold histograms (SQL functions only).

Every document has a 60-bit hash of its id. For each source, sizes are summed by hash bucket (the top 12 bits); running
sums over the buckets show in which one the source's budget ends, and only that bucket is split by the next 12 bits,
until a bucket is one hash value. Documents below the threshold are taken, so a smaller budget takes a subset of what a
larger one takes, nothing is sorted, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import unit_hash, word_count
from ledgerleaf.store import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS, LEVELS = 12, 5


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): the sources share the total by weight, none gets over ``max_repeats`` its size.

    Sources that would get more stop there, and the others share the rest by weight. With the sources in the order of
    cap / weight, those that stop are a first part of them, and running sums give the level that the rest reaches.
    The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double")
    listed = sizes.withColumn("_n", F.row_number().over(by_name) - 1).withColumn("_w", w)
    everything = Window.partitionBy()
    by_cap = Window.orderBy("_full", "_n")
    caps = listed.withColumn("_cap", F.col("source_size").cast("double") * max_repeats).withColumn("_full", F.col("_cap") / F.col("_w"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("_w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = caps.withColumn("_level", level).withColumn("_stops", F.col("_level") > F.col("_full"))
    shared = F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * shared))
    return levels.select("source", "source_size", target.alias("target"))


def _shares(small: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """For each source its target, how often all its documents are taken, and the threshold of those taken once more.

    ``small`` has source, size and hash (``_h``) of every document, and is a written table.
    """
    targets = source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    full = F.least(full, F.lit(max_repeats)).cast("long")
    state = targets.withColumn("_full", full).withColumn("_budget", F.col("target") - F.col("_full") * F.col("source_size"))
    state = materialize(state.withColumns({"_prefix": F.lit(0).cast("long"), "_below": F.lit(0).cast("long"), "_group": F.lit(0).cast("long")}), "state")
    for level in range(LEVELS):
        state = materialize(_refined(small, state, level), "state")
    return state.withColumn("_with", F.col("_below") + F.col("_group") - F.col("_budget") < F.col("_budget") - F.col("_below"))


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_hash(seed, F.col("doc_id")).alias("_h"))
    return materialize(rows, "sizes")


def _copies() -> Column:
    once_more = (F.col("_h") < F.col("_prefix")) | ((F.col("_h") == F.col("_prefix")) & F.col("_with"))
    return F.col("_full") + F.coalesce(once_more, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    A source whose target is several times its size gives every document as often as that fits, and once more those
    below the threshold of what remains. The threshold ends where the sum is nearest to the target.
    Defined cases: a null text has size 0; null is a source of its own and comes last; documents with the same doc_id
    share one fate; documents without words are taken like others of their hash and count 0; an empty table gives no rows.
    """
    small = _sizes(docs, seed)
    state = _shares(small, weights, max_repeats).alias("s")
    joined = small.alias("d").join(state, F.col("d.source").eqNullSafe(F.col("s.source"))).withColumn("copies", _copies())
    return joined.select("doc_id", "d.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mixture itself: each document as often as ``mix`` takes it, with all its columns, which may have any names.

    Defined cases: as in ``mix``; rows that share an id are taken alike, each as often as the other.
    """
    state = _shares(_sizes(docs, seed), weights, max_repeats).select("source", "_full", "_prefix", "_with")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), unit_hash(seed, F.col("doc_id")).alias("_h"))
    rows = rows.join(state, F.col("row.source").eqNullSafe(F.col("source"))).withColumn("_copies", _copies()).filter("_copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def _refined(small: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """The bucket of the next level in which each source's budget ends; a null prefix where there is none."""
    down = BITS * (LEVELS - level)
    rows = small.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    if level:
        rows = rows.filter(F.expr(f"shiftright(_h, {down}) = _prefix"))
    bucket = F.expr(f"shiftright(_h, {down - BITS})")
    sums = rows.groupBy("d.source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    # At most 4096 buckets for a source.
    upto = Window.partitionBy("source").orderBy("_bucket")
    running = sums.withColumn("_upto", F.sum("_sum").over(upto)).alias("b")
    over = running.join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).filter(F.col("_below") + F.col("_upto") > F.col("_budget"))
    first = over.groupBy("b.source").agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_first"))
    found = state.alias("s").join(first.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
    return found.select(
        "s.source", "source_size", "target", "_full", "_budget",
        F.col("_first._bucket").alias("_prefix"),
        (F.col("_below") + F.coalesce(F.col("_first._upto") - F.col("_first._sum"), F.lit(0))).alias("_below"),
        F.coalesce(F.col("_first._sum"), F.lit(0)).alias("_group"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), rounds AS (  -- in each round the sources over their cap stop there, until none is above
  SELECT 0 AS n, source, source_size, w, 3.0::DOUBLE * source_size AS cap, false AS stopped,
         w * (sum(source_size) OVER ())::DOUBLE / sum(w) OVER () AS target
  FROM s
  UNION ALL
  SELECT n + 1, source, source_size, w, cap, stops,
         CASE WHEN stops THEN cap ELSE w * (total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN stops THEN 0 ELSE w END) OVER () END
  FROM (SELECT *, stopped OR target > cap AS stops, (sum(source_size) OVER ())::DOUBLE AS total, bool_or(NOT stopped AND target > cap) OVER () AS again FROM rounds)
  WHERE again
), t AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS fully
  FROM rounds WHERE n = (SELECT max(n) FROM rounds)
), g AS (
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
), e AS (  -- the hash value in which the budget ends, and whether the sum with it is nearer
  SELECT g.source, arg_min(g.h, g.h) AS h, arg_min(g.upto - b.budget < b.budget - (g.upto - g.size), g.h) AS with_it
  FROM g JOIN (SELECT source, target - fully * source_size AS budget FROM t) b ON g.source IS NOT DISTINCT FROM b.source
  WHERE g.upto > b.budget GROUP BY g.source
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (t.fully + CASE WHEN d.h < e.h OR (d.h = e.h AND e.with_it) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
