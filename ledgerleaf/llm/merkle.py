"""Merkle manifest of a dataset (SQL functions only): a tree for each group, and one tree over the groups' roots.

The rows of a group keep their places while the tree grows: the node over places s*i to s*i + s - 1 lies in the row of
its first place. On each level the nodes of a run are a fixed number of rows apart, so ``lag`` and ``lead`` with that
offset, masked by the node's slot and the length of its run, bring its siblings, and the row of a run's first child
hashes the parent. All other rows take the siblings of their node from its first row.

Windows run over blocks of consecutive places, not over groups, so a group that holds most rows is spread over tasks.
The roots of the blocks are the places of the next round, and each round has a thousandth of the rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import CRC_TABLE, crc32_sql
from ledgerleaf.llm.ranks import rank_within
from ledgerleaf.store import materialize

#: Children of a node.
FAN = 2
#: Most leaves of a block.
BLOCK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Hash of a row's fields, each as its number of bytes, a colon and its text, or ``-`` for null."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest_of(*[framed(c) for c in fields])


def _climb(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Grow ``levels`` levels within each block of _g: adds _path (siblings by level) and _h, the root of the block.

    ``nodes`` has _g, _pos, _n (nodes of _g) and _h. _h comes back in the block's first row and is null in the others.
    """
    window = Window.partitionBy("_g", "_block").orderBy("_pos")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes.withColumn("_block", F.expr(f"_pos div {fan**levels}"))
    kept = out.columns
    for level in range(levels):
        step = fan**level
        apart = {f"_lag{j}": F.lag("_h", step * j).over(window) for j in range(1, fan)}
        apart |= {f"_lead{j}": F.lead("_h", step * j).over(window) for j in range(1, fan)}
        if level:
            apart[f"_s{level - 1}"] = F.last(f"_s{level - 1}", ignorenulls=True).over(upto)
        out = out.withColumns(apart)
        count = F.expr(f"(_n + {step - 1}) div {step}")
        slot = F.expr(f"_pos div {step} % {fan}")
        run = F.least(F.lit(fan), count - (F.expr(f"_pos div {step}") - slot))
        left = F.concat_ws("", *[F.when(slot >= j, F.col(f"_lag{j}")) for j in range(fan - 1, 0, -1)])
        right = F.concat_ws("", *[F.when(slot + j < run, F.col(f"_lead{j}")) for j in range(1, fan)])
        first, first_child = F.col("_pos") % step == 0, F.col("_pos") % (step * fan) == 0
        siblings = F.when(first & (count > 1), F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(first_child, F.when(count > 1, digest_of(F.col("_h"), right)).otherwise(F.col("_h")))
        before = [f"_s{i}" for i in range(level)]
        out = out.select(*[c for c in kept if c != "_h"], *before, siblings.alias(f"_s{level}"), parent.alias("_h"))
    out = out.withColumn(f"_s{levels - 1}", F.last(f"_s{levels - 1}", ignorenulls=True).over(upto))
    path = F.filter(F.array(*[F.col(f"_s{i}") for i in range(levels)]), lambda s: s.isNotNull()).cast(_PATH)
    return out.select(*kept, path.alias("_path"))


def _tree(nodes: DataFrame, most: int, fan: int, most_of_block: int) -> DataFrame:
    """Adds _path from each node to the root of its _g, and _top, that root. ``most`` is the largest _n."""
    levels = 1
    while fan**levels < most and fan ** (levels + 1) <= most_of_block:
        levels += 1
    block = fan**levels
    climbed = _climb(nodes, fan, levels)
    roots = climbed.filter(f"_pos % {block} = 0").select(
        "_g", F.col("_block").alias("_pos"), F.expr(f"(_n + {block - 1}) div {block}").alias("_n"), "_h"
    )
    roots = materialize(roots, "merkle-roots")
    if most > block:
        upper = _tree(roots, -(-most // block), fan, most_of_block)
    else:
        upper = roots.select("_g", "_pos", F.array().cast(_PATH).alias("_path"), F.col("_h").alias("_top"))
    upper = materialize(upper.select("_g", F.col("_pos").alias("_block"), F.col("_path").alias("_rest"), "_top"), "merkle-upper")
    return climbed.drop("_h").join(upper, ["_g", "_block"]).withColumn("_path", F.concat("_path", "_rest")).drop("_block", "_rest")


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Add subroot, root and path to a narrow table of leaves.

    ``path`` has, from the leaf's level up to the root, the hashes left and right of the leaf's node in its run, joined;
    both are empty where the run is one node. Leaves of a group are in ``order``, ties in the order of their hashes.
    Defined cases: null is a group of its own, before all others, and comes first in the order; repeated rows are leaves
    of their own; a group of one leaf has that leaf as its subroot; an empty table gives no rows. Other columns stay;
    columns named subroot, root or path are replaced.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    # One name for all columns of the caller, so that none clashes; equal rows get an order of their own.
    packed = leaves.select(
        F.struct(*kept).alias("_row"), F.col(group).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.col(leaf).alias("_h"), F.monotonically_increasing_id().alias("_tie"),
    )
    packed = materialize(packed, "merkle-leaves")
    by = [*[f"_o{i}" for i in range(len(order))], "_h", "_tie"]
    ranked = rank_within(packed, ["_key"], by, "_pos", "_n").select("_row", "_key", "_h", "_pos", "_n")
    ranked = materialize(ranked, "merkle-ranked")
    groups = materialize(rank_within(ranked.groupBy("_key").agg(F.max("_n").alias("_most")), [], ["_key"], "_g"), "merkle-groups")
    most, n_groups = groups.agg(F.max("_most"), F.count(F.lit(1))).first()
    nodes = ranked.join(groups.select(F.col("_key").alias("_of"), "_g"), F.col("_key").eqNullSafe(F.col("_of"))).drop("_of", "_key")
    within = _tree(nodes, most or 0, fan, block)
    tops = materialize(within.filter("_pos = 0").select("_g", "_top"), "merkle-subroots")
    over = tops.select(F.lit(0).alias("_g"), F.col("_g").alias("_pos"), F.lit(n_groups).cast("long").alias("_n"), F.col("_top").alias("_h"))
    over = _tree(over, n_groups, fan, block).select(F.col("_pos").alias("_g"), F.col("_path").alias("_over"), F.col("_top").alias("_root"))
    joined = within.join(materialize(over, "merkle-over"), "_g")
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_top").alias("subroot"), F.col("_root").alias("root"),
        F.concat("_path", "_over").alias("path"),
    )


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up, left to right."""
    return digest_of(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest_of(s.left, h, s.right))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: the manifest of all documents, and the check of each after some were tampered with."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    forged = {**fields, "n_chars": F.col("n_chars") + 1}
    leaves = docs.select(
        "doc_id", "lang", leaf_of(list(fields.values())).alias("leaf"), F.when(hit, leaf_of(list(forged.values()))).alias("forged")
    )
    out = manifest(leaves, "lang", ["doc_id"])
    out = out.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce({crc32_sql("doc_id")} % 7 = 0, false) AS hit
  FROM documents, crc_table
), l AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS forged FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), a AS (
  SELECT 0 AS lev, lang, pos, n, leaf AS h FROM p
  UNION ALL SELECT lev + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY lev, lang, pos // 2, n
), s AS (
  SELECT lang, h AS subroot, lev AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM a WHERE n = 1
), b AS (
  SELECT 0 AS lev, g AS pos, n, subroot AS h FROM s
  UNION ALL SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lev, pos // 2, n
), f AS (
  SELECT r, p.lang, g, 0 AS lev, pos AS at, height, coalesce(forged, leaf) AS h, '' AS proof FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT f.r, f.lang, f.g, f.lev + 1, CASE WHEN f.lev + 1 = f.height THEN f.g ELSE f.at // 2 END, f.height,
    sha256(CASE WHEN f.at % 2 = 0 THEN f.h || coalesce(a.h, b.h, '') ELSE coalesce(a.h, b.h) || f.h END), f.proof || coalesce(a.h, b.h, '')
  FROM f LEFT JOIN a ON f.lev < f.height AND a.lev = f.lev AND a.lang IS NOT DISTINCT FROM f.lang AND a.pos = xor(f.at, 1)
    LEFT JOIN b ON f.lev >= f.height AND b.lev = f.lev - f.height AND b.pos = xor(f.at, 1)
  WHERE f.lev < f.height + (SELECT max(lev) FROM b)
)
SELECT p.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN f ON f.r = p.r AND f.lev = s.height + (SELECT max(lev) FROM b),
  (SELECT h AS root FROM b WHERE n = 1)
"""
